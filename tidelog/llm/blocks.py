"""Blocks of documents, for joins of a text's items against tables that grow with the corpus.

Rather than one row for each item of each text, a block of documents (a few MB of text) asks for each of its distinct
items once; the answers meet the block's texts in a cogroup. The request table is about a tenth of the text, and no
item, however frequent, has more than one row for each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import give_back, total_chars


def blocked(docs: DataFrame, *keep: Column, text_col: str = "text", chars: int = 16_000_000) -> DataFrame:
    """The kept columns, text (null: empty) and block, of about ``chars`` characters.

    The block follows from the row's content alone, so that it is the same whenever the row is computed; copies of a
    text under different ids are spread.
    """
    n = max(1, -(-total_chars(docs, text_col) // chars))
    block = F.pmod(F.xxhash64(*keep, F.col(text_col)), F.lit(n)).cast("int")
    return docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("text"), block.alias("block"))


def per_block(docs: DataFrame, run: Callable[[int, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run(block, its rows) for every block."""

    def done(key: tuple, rows: pa.Table) -> pa.Table:
        out = run(key[0].as_py(), rows)
        give_back()
        return out

    return docs.groupBy("block").applyInArrow(done, schema)


def met(docs: DataFrame, answers: DataFrame, run: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run(block, its rows, its answers) for every block that has rows."""

    def done(key: tuple, rows: pa.Table, own: pa.Table) -> pa.Table:
        out = run(key[0].as_py(), rows, own)
        give_back()
        return out

    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(done, schema)


def texts(rows: pa.Table, name: str = "text", most: int = 1_000_000) -> Iterator[tuple[pa.Table, list[str]]]:
    """Slices of a table with their texts, of about ``most`` bytes of text (a longer text is a slice of its own), so that little is unpacked at a time."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(rows.column(name)), 0).to_numpy())
    at = 0
    while at < rows.num_rows:
        base = int(upto[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(upto, base + most, side="right")))
        part = rows.slice(at, end - at)
        yield part, part.column(name).to_pylist()
        at = end

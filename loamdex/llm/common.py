"""What the operators of this subpackage share: input columns, sizes and small helpers."""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a longest run of characters outside this set of white space, as a Java and RE2 pattern.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def only(df: DataFrame, **types: str) -> DataFrame:
    """The named columns alone, cast, so that extra or clashing columns of the input play no part."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in types.items()])


def words(text: Column) -> Column:
    """The words of `text` as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """`text` with A-Z in lower case and all else as it is. lower() does that where no other capital is in the text; the
    slower translate() is left for what has one."""
    capital = text.rlike(r"[^\x00-\x7F&&[\p{IsUppercase}\p{IsTitlecase}]]")
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain | ~capital, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def sub_batches(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to `most` at most, or one row if it alone is larger."""
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def text_slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch whose texts have `most` bytes at most (or one text), with the texts as UTF-8; null is empty."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for begin, end in sub_batches(sizes, most):
        part = batch.slice(begin, end - begin)
        yield part, [b"" if t is None else t for t in part.column(column).cast(pa.binary()).to_pylist()]


def hash_sample(df: DataFrame, size: int, *keys: str) -> DataFrame:
    """At most `size` rows by the order of the keys' hash. Rows beyond a multiple of `size` are left out before the sort,
    so that what tasks send on stays in proportion to `size`, not to the number of tasks; but where repeated keys leave
    too few, all are sorted."""
    n, h = df.count(), F.xxhash64(keys[0])
    if n > 2 * size:
        some = df.filter(F.pmod(h, F.lit(1 << 30)) < int((1 << 30) * 1.5 * size / n))
        if some.count() >= size:
            df = some
    return df.orderBy(h, *keys).limit(size)

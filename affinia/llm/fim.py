"""Fill-in-middle documents by rotating blocks of a byte array in place.

A text is cut at two code points into prefix, middle and suffix. The sentinels go
into a bytearray in front of their segments, as `<P>`prefix`<M>`middle`<S>`suffix.
Exchanging two neighbouring blocks is a rotation: reverse each block, then both
together. psm rotates middle and suffix; spm rotates prefix and middle against the
suffix. Restoring finds the sentinels, rotates back and takes them out.

A sentinel cannot arise where a segment and a sentinel meet, since `<` and `>`
stand only at a sentinel's ends; texts that hold one themselves stay plain. So a
restored text equals the original in every byte.

Defined results: a null text counts as empty and stays plain, as do texts that
hold a sentinel; a null id draws from the digest of the seed and a colon alone;
rows that repeat an id draw the same numbers; an empty table gives an empty table. All columns of
the caller stay; the result is one struct, in place of a column of that name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
RATE = 90  # of 100 texts that are transformed
SPM_RATE = 20  # of 100 transformed ones
FIM_TYPE = "struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string>"


def rotate(block: np.ndarray, cut: int) -> None:
    """Exchange block[:cut] and block[cut:] in place by three reversals."""
    for part in (block[:cut], block[cut:], block):
        part[:] = part[::-1]


def draws(seed: str, doc_id) -> list[int]:
    """The first four 32-bit numbers of the digest of seed, colon and id."""
    text = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(text[8 * i : 8 * i + 8], 16) for i in range(4)]


def byte_cuts(raw: bytes, cuts: list[int], n: int) -> list[int]:
    """Byte offsets of code point offsets."""
    if n == len(raw):
        return cuts
    heads = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return [int(heads[c]) if c < n else len(raw) for c in cuts]


def transform(raw: bytes, seed: str, doc_id, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, bytes]:
    """Code points, form, code points of prefix and middle, and the output."""
    n = len(raw) if raw.isascii() else int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))
    h = draws(seed, doc_id)
    if not raw or h[2] % 100 >= rate or any(mark in raw for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, PLAIN, None, None, raw
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = byte_cuts(raw, [first, second], n)
    out = bytearray(raw)
    out[b:b] = SUFFIX
    out[a:a] = MIDDLE
    out[0:0] = PREFIX
    middle, suffix = len(PREFIX) + a, len(PREFIX) + len(MIDDLE) + b  # where their sentinels stand
    form = SPM if h[3] % 100 < spm_rate else PSM
    block = np.frombuffer(out, np.uint8)
    if form == SPM:
        rotate(block, suffix)
    else:
        rotate(block[middle:], suffix - middle)
    del block
    return n, form, first, second - first, bytes(out)


def restore(output: bytes, form: str) -> bytes:
    """The text that `transform` was given, from its output and form alone."""
    if form == PLAIN:
        return output
    out = bytearray(output)
    block = np.frombuffer(out, np.uint8)
    if form == SPM:
        at = out.index(PREFIX)  # the suffix and its sentinel come before
        rotate(block, at)
        suffix = len(out) - at
        middle = out.index(MIDDLE)
    else:
        middle = out.index(SUFFIX)
        at = out.index(MIDDLE)
        rotate(block[middle:], at - middle)
        suffix = middle + len(out) - at
    del block
    for place in (suffix, middle, 0):
        del out[place : place + len(PREFIX)]
    return bytes(out)


def _raw(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def fill_in_middle(
    docs: DataFrame, seed: str = "1", rate: int = RATE, spm_rate: int = SPM_RATE,
    id_col: str = "doc_id", text_col: str = "text", out_col: str = "_fim",
) -> DataFrame:
    """All rows and columns of `docs`, and `out_col` = struct(n, form, prefix_chars, middle_chars, output)."""

    @F.arrow_udf(FIM_TYPE)
    def turn(ids: pa.Array, texts: pa.Array) -> pa.Array:
        rows = [transform(raw, seed, i, rate, spm_rate) for i, raw in zip(ids.to_pylist(), _raw(texts))]
        n, form, prefix, middle, output = zip(*rows) if rows else ((),) * 5
        columns = [
            pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
            pa.array(output, pa.binary()).cast(pa.string()),
        ]
        return pa.StructArray.from_arrays(columns, ["n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.withColumn(out_col, turn(F.col(id_col).cast("string"), F.col(text_col)))


def restored(output: Column, form: Column) -> Column:
    """The original texts of outputs."""

    @F.arrow_udf("string")
    def back(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        rows = [restore(raw, kind) for raw, kind in zip(_raw(outputs), forms.to_pylist())]
        return pa.array(rows, pa.binary()).cast(pa.string())

    return back(output, form)

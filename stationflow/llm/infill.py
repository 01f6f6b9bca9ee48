"""Fill-in-middle transformation of texts, batch by batch in ``pyarrow.compute``.

A text is cut into units: runs of ASCII letters, and every other code point by itself. Each
batch goes through one columnar pipeline: the units become list arrays, the lists are
flattened with the number of their row, a unit's ordinal follows from its row's offset, the
ordinal gives its role (prefix, middle or suffix), each role's units are filtered out, put back
into lists and joined, and the pieces are joined around the markers. No step loops over rows
or units in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The markers before prefix, suffix and middle.
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
# A unit in UTF-8 bytes, and a byte that UTF-8 never holds.
UNIT, END = rb"([A-Za-z]+|[\x00-\x7F]|[\xC0-\xFF][\x80-\xBF]*)", b"\xff"
SLICE_BYTES = 1 << 20
RESULT = pa.struct([("n", pa.int64()), ("form", pa.string()), ("output", pa.string()),
                    ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])


def slices(sizes: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, rows) of consecutive rows that end in the same ``most`` bytes of the batch."""
    group = np.cumsum(sizes) // most
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    for a, b in zip(starts, np.append(starts, len(sizes))[1:], strict=True):
        yield int(a), int(b - a)


def units(texts: pa.Array) -> pa.Array:
    """Lists of the texts' units, as bytes. Joined, a list gives its text."""
    ended = pc.replace_substring_regex(texts.cast(pa.large_binary()), UNIT, rb"\1" + END)
    parts = pc.split_pattern(ended, END)
    # Every unit is followed by the end byte, so the last part of each list is empty.
    flat, row = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy()
    last = np.flatnonzero(np.diff(row, append=-1))
    keep = np.ones(len(flat), bool)
    keep[last] = False
    return _lists(flat, row, keep, len(texts))


def _lists(flat: pa.Array, row: np.ndarray, keep: np.ndarray, rows: int) -> pa.Array:
    """The kept values as one list for each row."""
    offsets = np.zeros(rows + 1, np.int64)
    np.cumsum(np.bincount(row[keep], minlength=rows), out=offsets[1:])
    return pa.LargeListArray.from_arrays(pa.array(offsets), flat.filter(pa.array(keep)))


def transformed(texts: pa.Array, one: np.ndarray, two: np.ndarray, form: pa.Array) -> pa.Array:
    """One slice: structs of ``RESULT``. ``one`` and ``two`` choose the cuts, ``form`` is null where
    the text stays plain whatever it holds."""
    texts = pc.fill_null(texts, "")
    lists = units(texts)
    n = pc.list_value_length(lists).to_numpy()
    first, second = one % (n + 1), two % (n + 1)
    flat, row = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    ordinal = np.arange(len(flat)) - lists.offsets.to_numpy()[:-1][row]
    role = (ordinal >= np.minimum(first, second)[row]).astype(np.int8) + (ordinal >= np.maximum(first, second)[row])
    empty = pa.scalar(b"", pa.large_binary())
    piece = {name: pc.binary_join(_lists(flat, row, role == i, len(texts)), empty).cast(pa.large_string())
             for i, name in enumerate(("prefix", "middle", "suffix"))}
    # A text that holds a marker could not be told from the pieces.
    whole = pc.or_(pc.equal(pc.binary_length(texts), 0), pc.match_substring_regex(texts, "|".join(MARKS.values())))
    form = pc.if_else(pc.or_(whole, pc.is_null(form)), "plain", form)

    def around(*order: str) -> pa.Array:
        return pc.binary_join_element_wise(*[x for name in order for x in (
            pa.scalar(MARKS[name], pa.large_string()), piece[name])], pa.scalar("", pa.large_string()))

    plain = pc.equal(form, "plain")
    output = pc.if_else(plain, texts.cast(pa.large_string()), pc.if_else(
        pc.equal(form, "spm"), around("suffix", "prefix", "middle"), around("prefix", "suffix", "middle")))
    chars = {name: pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(piece[name]).cast(pa.int64()))
             for name in ("prefix", "middle")}
    return pa.StructArray.from_arrays(
        [pa.array(n, pa.int64()), form.cast(pa.string()), output.cast(pa.string()), chars["prefix"], chars["middle"]],
        fields=list(RESULT))


def _joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _sizes(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1


def infilled(text: Column, one: Column, two: Column, form: Column) -> Column:
    """Struct (n, form, output, prefix_chars, middle_chars) of a text; see ``fill_in_middle``."""

    @F.arrow_udf("n bigint, form string, output string, prefix_chars bigint, middle_chars bigint")
    def of(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, a, b, forms in batches:
            a, b = a.to_numpy(), b.to_numpy()
            yield _joined([transformed(texts.slice(i, k), a[i:i + k], b[i:i + k], forms.slice(i, k))
                           for i, k in slices(_sizes(texts))], RESULT)

    return of(text, one, two, form)


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form came from."""
    order = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}

    def cut(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        answer = outputs
        for name, parts in order.items():
            pattern = "(?s)^" + "".join(f"{MARKS[p]}(?P<{p}>.*?)" for p in parts) + "$"
            found = pc.extract_regex(outputs, pattern)
            text = pc.binary_join_element_wise(*[pc.struct_field(found, p) for p in ("prefix", "middle", "suffix")], "")
            answer = pc.if_else(pc.equal(forms, name), text, answer)
        return answer

    @F.arrow_udf("string")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for outputs, forms in batches:
            yield _joined([cut(outputs.slice(i, k), forms.slice(i, k)) for i, k in slices(_sizes(outputs))], pa.string())

    return of(output, form)


def draw(doc_id: Column, part: int, seed: str = "1:") -> Column:
    """Unsigned 32 bits drawn by an id: the part-th (from 0) 8-digit group of a hex digest.

    A null id draws like an empty one.
    """
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * part + 1, 8), 16, 10).cast("bigint")


def fill_in_middle(docs: DataFrame, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """doc_id, n (units), form, output, prefix_chars, middle_chars for each row of ``docs``.

    Two draws by the id cut the text before and after its middle; a third leaves it plain in
    ``100 - plain_from`` of 100 cases, a fourth makes ``spm_below`` of 100 of the others
    suffix-first. Empty and null texts are plain with an empty output, a text that holds a
    marker stays plain; plain texts have null lengths. Repeated rows each give a row with the
    same result, a null id draws like an empty one. Texts are never cut short; a batch
    is worked off in slices of about 1 MB or one longer text.
    """
    form = F.when(draw(F.col("doc_id"), 2) % 100 < plain_from,
                  F.when(draw(F.col("doc_id"), 3) % 100 < spm_below, "spm").otherwise("psm"))
    made = docs.select("doc_id", infilled(F.col("text"), draw(F.col("doc_id"), 0), draw(F.col("doc_id"), 1), form).alias("r"))
    return made.select("doc_id", "r.*")

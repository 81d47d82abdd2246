"""Fill-in-middle: texts are cut into prefix, middle and suffix of whole units, and put together in the order that a model is trained on."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINELS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
SLICE = 8 << 20  # bytes of text that the arrays of one step are made of; a longer text goes alone


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of at most SLICE bytes of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def _joined(units: pa.Array, parent: np.ndarray, chosen: np.ndarray, rows: int) -> pa.Array:
    """The chosen units of each row, one after another; parent is ascending."""
    offsets = np.r_[0, np.cumsum(np.bincount(parent[chosen], minlength=rows))]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), units.filter(pa.array(chosen))), "")


def rearranged(text: pa.Array, draws: np.ndarray, separator: str, sentinels: tuple[str, str, str], rate: int, spm_rate: int) -> dict[str, pa.Array]:
    """The columns n, form, prefix_chars, middle_chars and output of some texts without null; draws has four numbers of each."""
    rows = len(text)
    pieces = pc.split_pattern(text, separator)
    units, parent = pc.list_flatten(pieces), pc.list_parent_indices(pieces).to_numpy()
    count = pc.list_value_length(pieces).to_numpy().astype(np.int64)
    first = np.cumsum(count) - count
    ordinal = np.arange(len(parent)) - first[parent]
    last = ordinal == count[parent] - 1
    units = pc.binary_join_element_wise(units, pc.if_else(pa.array(last), pa.scalar(""), pa.scalar(separator)), "")
    real = ~last | (pc.binary_length(units).to_numpy() > 0)  # nothing stands after a separator that ends the text
    n = np.bincount(parent[real], minlength=rows)

    cuts = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    role = (ordinal >= cuts[parent, 0]).astype(np.int8) + (ordinal >= cuts[parent, 1])
    prefix, middle, suffix = (_joined(units, parent, real & (role == r), rows) for r in range(3))

    plain = (n == 0) | (draws[:, 2] % 100 >= rate)
    for s in sentinels:
        plain |= pc.match_substring(text, s).to_numpy(zero_copy_only=False)
    spm, plain = pa.array(draws[:, 3] % 100 < spm_rate), pa.array(plain)
    p, s, m = map(pa.scalar, sentinels)
    output = pc.if_else(spm, pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, ""), pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, ""))
    none = pa.scalar(None, pa.int64())
    return {
        "n": pa.array(n, pa.int64()),
        "form": pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")),
        "prefix_chars": pc.if_else(plain, none, pc.utf8_length(prefix).cast(pa.int64())),
        "middle_chars": pc.if_else(plain, none, pc.utf8_length(middle).cast(pa.int64())),
        "output": pc.if_else(plain, text, output),
    }


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, separator: str = "\n", sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n, form, prefix_chars, middle_chars, output.

    A text's n units each end with the separator, but for a last one without it. Four numbers of a document come from the
    SHA-256 of seed and id: two cuts, each after any number of units, bound the middle; `rate` of 100 documents are
    rearranged, `spm_rate` of 100 of those with the suffix first. A text that is empty or has a sentinel in it stays as it
    is (form plain), so that restore() is exact; then the two lengths, in code points, are null.

    A null text is empty, a null id counts as an empty one; rows of equal id and text give equal rows; other columns don't pass.
    Nothing is shuffled. A task holds a few times SLICE bytes, or of the longest text. Empty table, empty result.
    """
    assert len(set(sentinels)) == 3 and all(sentinels) and separator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "text"):
                draws = np.stack([part.column(f"h{i}").to_numpy() for i in range(1, 5)], axis=1)
                columns = rearranged(part.column("text"), draws, separator, sentinels, rate, spm_rate)
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns.values()], names=["id", *columns])

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *numbers)
    return found.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that transform() made an output of."""
    parts = F.split(output, "|".join(re.escape(s) for s in sentinels), -1)
    part = lambda *at: F.concat(*[F.get(parts, F.lit(i)) for i in at])
    return F.when(form == "psm", part(1, 3, 2)).when(form == "spm", part(2, 3, 1)).otherwise(output)

"""From Arrow string columns to the kernels and back: rows of equal lengths are aligned together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import kernel2d, kernel3d
from .config import AlignConfig

ALIGNED_2D = pa.struct([("aligned1", pa.string()), ("aligned2", pa.string()), ("score", pa.float64())])
ALIGNED_3D = pa.struct([("aligned1", pa.string()), ("aligned2", pa.string()), ("aligned3", pa.string()), ("score", pa.float64())])
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[ord("a") : ord("z") + 1] -= 32


class _Column:
    """A string column as one byte array, upper-cased; letters of a row are at [start, start + length)."""

    def __init__(self, column: pa.Array):
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        self.valid = column.is_valid().to_numpy(zero_copy_only=False)
        data = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
        offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        self.start, self.length = offsets[:-1], np.diff(offsets)
        raw = np.frombuffer(data.buffers()[2], np.uint8) if data.buffers()[2] is not None else np.zeros(0, np.uint8)
        if len(offsets) and (raw[offsets[0] : offsets[-1]] > 127).any():
            raise ValueError("sequences must be ASCII")
        self.letters = _UPPER[raw]

    def rows(self, which: np.ndarray, length: int) -> np.ndarray:
        return self.letters[self.start[which][:, None] + np.arange(length)[None, :]] if length else np.zeros((len(which), 0), np.uint8)


def _groups(columns: list[_Column]):
    """(row numbers, lengths) for each combination of lengths, rows with a null left out."""
    valid = np.flatnonzero(np.logical_and.reduce([c.valid for c in columns]))
    if not len(valid):
        return
    lengths = np.stack([c.length[valid] for c in columns])
    order = np.lexsort(lengths[::-1])
    lengths, valid = lengths[:, order], valid[order]
    cuts = np.flatnonzero((np.diff(lengths, axis=1) != 0).any(axis=0)) + 1
    for rows, at in zip(np.split(valid, cuts), [0, *cuts], strict=True):
        yield rows, tuple(int(x) for x in lengths[:, at])


def align_columns(columns: list[pa.Array], config: AlignConfig, traceback: bool) -> pa.Array:
    """Two or three string columns → a struct of aligned strings and score, or the score alone. Null where any input is null."""
    if len(config.free) != 2 * len(columns):
        raise ValueError(f"{len(columns)} sequences need {2 * len(columns)} free-end flags")
    parsed, dense = [_Column(c) for c in columns], config.matrix.dense()
    total = len(columns[0])
    scores = np.full(total, np.nan)
    texts: list[list[pa.Array]] = [[] for _ in columns]
    order: list[np.ndarray] = []
    for rows, lengths in _groups(parsed):
        size = kernel2d.pairs_at_once(*lengths, traceback) if len(columns) == 2 else kernel3d.triples_at_once(*lengths, traceback)
        for at in range(0, len(rows), size):
            part = rows[at : at + size]
            own = [c.rows(part, n) for c, n in zip(parsed, lengths, strict=True)]
            if len(columns) == 2:
                scores[part], steps = kernel2d.align_block(*own, config, dense, traceback)
            else:
                scores[part], steps = kernel3d.align_block(tuple(own), config, dense, traceback)
            if traceback:
                lines, begin = kernel2d.render_block(*own, steps) if len(columns) == 2 else kernel3d.render_block(tuple(own), steps)
                order.append(part)
                offsets = pa.py_buffer(begin.astype(np.int32).tobytes())
                for target, line in zip(texts, lines, strict=True):
                    target.append(pa.StringArray.from_buffers(len(part), offsets, pa.py_buffer(line.tobytes())))
    missing = ~np.logical_and.reduce([c.valid for c in parsed])
    score = pa.array(scores, mask=missing)
    if not traceback:
        return score
    place = np.full(total, -1, np.int64)  # of each row among the aligned ones
    aligned = np.concatenate(order) if order else np.zeros(0, np.int64)
    place[aligned] = np.arange(len(aligned))
    take = pa.array(place, mask=place < 0)
    strings = [pa.concat_arrays(t).take(take) if t else pa.nulls(total, pa.string()) for t in texts]
    names = [f"aligned{k + 1}" for k in range(len(columns))]
    return pa.StructArray.from_arrays([*strings, score], names=[*names, "score"], mask=pa.array(missing))

"""Score events as single lines of text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .dna import _col


def format_event(event) -> Column:
    """`[score_alignment] event=... scaled_penalty=...` with six significant digits (%g has no twin among JVM functions);
    third positions and characters only where there are any."""

    @F.arrow_udf("string")
    def run(events: pa.Array) -> pa.Array:
        out = []
        for e in events.to_pylist():
            if e is None:
                out.append(None)
                continue
            parts = [f"{k}={e[k]}" for k in ("event", "col_idx", "seq1_pos", "seq2_pos")]
            parts += [f"seq3_pos={e['seq3_pos']}"] if e["seq3_pos"] is not None else []
            parts += [f"mask={e['mask']}", f"prev_mask={e['prev_mask']}"]
            parts += [f"{k}={e[k]:.6g}" for k in ("raw_penalty", "factor", "scaled_penalty")]
            parts += [f"{k}={e[k]}" for k in ("seq1_char", "seq2_char", "seq3_char") if e[k] is not None]
            out.append("[score_alignment] " + " ".join(parts))
        return pa.array(out, pa.string())

    return run(_col(event))


def print_events(events) -> None:
    """A sink: every event of a DataFrame with a struct column `event`, on its executor's standard output."""
    events.select(format_event("event").alias("line")).foreach(lambda r: print(r["line"]))

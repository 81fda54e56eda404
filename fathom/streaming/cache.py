"""Semantic cache over a stream of questions.

Per tenant the cache holds the vectors of earlier misses. A question is a hit if its best cosine with one of
them reaches the threshold (the first best wins, negatives never match); otherwise it is a miss and is stored.
Within a micro-batch, questions are taken in order of seq.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

OUTPUT = "tenant string, seq long, hit boolean, answered_by long, sim double"
STATE = "seqs array<long>, vectors array<double>"


def fold(rows: pd.DataFrame, seqs: list[int], stored: np.ndarray, threshold: float) -> tuple[list[tuple], list[int], np.ndarray]:
    """The rows' outcomes and the cache after them."""
    out = []
    for seq, vec in rows.sort_values("seq")[["seq", "vec"]].itertuples(index=False):
        v = np.asarray(vec, float)
        best, at = 0.0, None
        if len(seqs):
            sims = stored @ v / (np.sqrt((stored * stored).sum(1)) * np.sqrt(v @ v) + 1e-8)
            i = int(np.argmax(sims))
            if sims[i] > 0:
                best, at = float(sims[i]), seqs[i]
        if at is not None and best >= threshold:
            out.append((seq, True, at, best))
        else:
            out.append((seq, False, seq, best))
            seqs, stored = [*seqs, seq], np.vstack([stored, v]) if len(seqs) else v[None]
    return out, seqs, stored


def cached(questions: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Outcomes of a (streaming) table (tenant, seq, vec), one row a question."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        seqs, flat = state.get if state.exists else ([], [])
        seqs = list(seqs)
        stored = np.asarray(flat, float).reshape(len(seqs), -1) if len(seqs) else np.zeros((0, 0))
        rows = pd.concat(list(frames))
        out, seqs, stored = fold(rows, seqs, stored, threshold)
        state.update((seqs, stored.ravel().tolist()))
        yield pd.DataFrame([(key[0], *o) for o in out], columns=["tenant", "seq", "hit", "answered_by", "sim"])

    return questions.groupBy("tenant").applyInPandasWithState(run, OUTPUT, STATE, "append", "NoTimeout")

"""Immutable alignment settings, fixed on the driver: score matrix, gap costs, free ends and column scaling."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from itertools import product

import numpy as np

#: Watson-Crick complements; every other character stands for itself.
COMPLEMENT_FROM, COMPLEMENT_TO = "ACGTacgt", "TGCAtgca"
FLAGS_2D = ("seq1_left", "seq1_right", "seq2_left", "seq2_right")


def complement(text: str) -> str:
    return text.translate(str.maketrans(COMPLEMENT_FROM, COMPLEMENT_TO))


def reverse_complement(text: str) -> str:
    return complement(text)[::-1]


class ScoreMatrix:
    """Substitution scores, matrix[x][y] with x from the first sequence. Keys are upper-cased ASCII letters."""

    def __init__(self, scores: Mapping[str, Mapping[str, float]], on_missing: str = "error"):
        if on_missing not in ("error", "zero"):
            raise ValueError("on_missing must be 'error' or 'zero'")
        self.scores = {x.upper(): {y.upper(): float(s) for y, s in row.items()} for x, row in scores.items()}
        self.on_missing = on_missing
        for key in {*self.scores, *(y for row in self.scores.values() for y in row)}:
            if len(key) != 1 or not key.isascii():
                raise ValueError(f"matrix keys must be single ASCII characters, not {key!r}")

    @classmethod
    def simple(cls, match: float = 2, mismatch: float = -1, letters: str = "ACGT", **how) -> ScoreMatrix:
        return cls({x: {y: match if x == y else mismatch for y in letters} for x in letters}, **how)

    def dense(self) -> np.ndarray:
        """float64[256, 256]; a pair that the matrix lacks is nan, or 0 with on_missing='zero'."""
        out = np.full((256, 256), 0.0 if self.on_missing == "zero" else np.nan)
        for x, row in self.scores.items():
            for y, s in row.items():
                out[ord(x), ord(y)] = s
        return out

    def rows(self) -> list[tuple[str, str, float]]:
        """The relation (x, y, s)."""
        return [(x, y, s) for x, row in self.scores.items() for y, s in row.items()]

    def _holds(self, change: Callable[[str, str], tuple[str, str]]) -> bool:
        for x, y in product("ACGT", repeat=2):
            a, b = change(x, y)
            if self.scores[x][y] != self.scores[a][b]:
                return False
        return True

    def transpose_symmetric(self) -> bool:
        return self._holds(lambda x, y: (y, x))

    def complement_symmetric(self) -> bool:
        return self._holds(lambda x, y: (complement(x), complement(y)))


#: The matrices that sweeps use, and a directional one.
BASIC = ScoreMatrix.simple()
COMP_SYMMETRIC = ScoreMatrix(
    {
        "A": {"A": 2, "C": -1, "G": -1, "T": -1},
        "C": {"A": -1, "C": 3, "G": -1, "T": -1},
        "G": {"A": -1, "C": -1, "G": 3, "T": -1},
        "T": {"A": -1, "C": -1, "G": -1, "T": 2},
    }
)
NON_COMP_SYMMETRIC = ScoreMatrix(
    {
        "A": {"A": 4, "C": -1, "G": -2, "T": -3},
        "C": {"A": -1, "C": 3, "G": -1, "T": -2},
        "G": {"A": -2, "C": -1, "G": 2, "T": -1},
        "T": {"A": -3, "C": -2, "G": -1, "T": 1},
    }
)
DIRECTIONAL = ScoreMatrix({x: {y: 2 if x == y else -1 if x < y else -2 for y in "ACGT"} for x in "ACGT"})


@dataclass(frozen=True)
class Scaler:
    """A column's factor: the sum over enabled free ends of 1 / ((index + 1) / temperature) ** decay; 1 if none is enabled."""

    decay: float = 1.0
    temperature: float = 1.0

    def __post_init__(self) -> None:
        if not self.temperature > 0:
            raise ValueError("temperature must be > 0")

    def __call__(self, *indices: int, **free: bool) -> float:
        flags = [free[f"{name}_free"] for name in FLAGS_2D]
        if not any(flags):
            return 1.0
        return sum(self.term(k) for k, on in zip(indices, flags, strict=True) if on)

    def term(self, index):
        return 1.0 / (((index + 1) / self.temperature) ** self.decay)


INVERSE_DISTANCE = Scaler()


@dataclass(frozen=True)
class AlignConfig:
    """Everything but the sequences. `scaler` is a Scaler, None (factor 1), or any callable of four indices and four flags."""

    matrix: ScoreMatrix = field(default_factory=lambda: BASIC)
    gap_open: float = -5.0
    gap_extend: float = -1.0
    gap_close: bool = True
    free: tuple[bool, ...] = (False,) * 4
    scaler: Scaler | Callable[..., float] | None = INVERSE_DISTANCE

    def __post_init__(self) -> None:
        if len(self.free) not in (4, 6):
            raise ValueError("free needs four flags for two sequences, six for three")
        object.__setattr__(self, "free", tuple(bool(x) for x in self.free))

    @property
    def costs(self) -> tuple[float, float]:
        """(cost of a run's first column, cost of its end): the open-extend difference is split in halves, or all in front."""
        if not self.gap_close:
            return float(self.gap_open), 0.0
        half = (self.gap_open - self.gap_extend) / 2
        return self.gap_extend + half, half

    def but(self, **changes) -> AlignConfig:
        return replace(self, **changes)


def flag_string(flags: Iterable[bool]) -> str:
    return "".join("01"[bool(x)] for x in flags)


def flags_of(text: str) -> tuple[bool, ...]:
    return tuple(x == "1" for x in text)


#: Free ends of a dimer: the second strand overhangs on the left, the first on the right.
DIMER_FREE = (False, True, True, False)
#: Free ends of dimer, first primer and reverse-complemented second primer.
DIMER3_FREE = (False, False, False, True, True, False)


def factor_planes(config: AlignConfig, n: int, m: int) -> np.ndarray:
    """float64[3, n + 1, m + 1]: the factor of a column of each kind that ends at (i, j); 0 where no such column can be.

    Kind 0 pairs two letters, 1 has a gap in the first sequence, 2 a gap in the second."""
    planes = np.zeros((3, n + 1, m + 1))
    i, j = np.arange(n + 1), np.arange(m + 1)
    for kind in range(3):
        first, second = (i if kind == 1 else i - 1), (j if kind == 2 else j - 1)
        reach = np.ones((n + 1, m + 1), bool)
        if kind != 1:
            reach[0] = False
        if kind != 2:
            reach[:, 0] = False
        scaler = config.scaler
        if scaler is None or not any(config.free[:4]) and isinstance(scaler, Scaler):
            planes[kind][reach] = 1.0
        elif isinstance(scaler, Scaler):
            total = np.zeros((n + 1, m + 1))
            for axis, (flag, index) in enumerate(zip(config.free, (first, n - i, second, m - j), strict=True)):
                if flag:
                    term = scaler.term(np.maximum(index, 0).astype(float))
                    total = total + (term[:, None] if axis < 2 else term[None, :])
            planes[kind][reach] = total[reach]
        else:
            named = {f"{name}_free": f for name, f in zip(FLAGS_2D, config.free, strict=True)}
            for a, b in zip(*np.nonzero(reach), strict=True):
                planes[kind, a, b] = scaler(int(first[a]), int(n - a), int(second[b]), int(m - b), **named)
    return planes

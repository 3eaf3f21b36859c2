"""Noise and what it costs: a budget adds up the epsilons of all releases of a column."""

from __future__ import annotations

import math
import threading
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .policy import PolicyViolation


class Budget:
    """The sum of epsilons that releases may take, one after another."""

    _lock = threading.Lock()

    def __init__(self, epsilon: float) -> None:
        if not 0 < epsilon < math.inf:
            raise ValueError("a budget needs a finite epsilon above 0")
        self.epsilon, self.spent = epsilon, 0.0

    @property
    def left(self) -> float:
        return self.epsilon - self.spent

    @staticmethod
    def charge_all(costs: Iterable[tuple[Budget, float]]) -> None:
        """All of the costs, or none if a budget doesn't have as much left."""
        total: dict[Budget, float] = defaultdict(float)
        for budget, epsilon in costs:
            total[budget] += epsilon
        with Budget._lock:
            for budget, epsilon in total.items():
                if epsilon > budget.left + 1e-12:
                    raise PolicyViolation(f"noise of epsilon {epsilon:g} where {max(budget.left, 0):g} is left")
            for budget, epsilon in total.items():
                budget.spent += epsilon


def laplace_of(epsilon: float, sensitivity: float) -> Column:
    """A draw for each row, of scale sensitivity / epsilon; Spark picks the seed of each plan."""
    if not 0 < epsilon < math.inf or not 0 < sensitivity < math.inf:
        raise ValueError("noise needs a finite epsilon and a sensitivity above 0")
    # one draw for each side: the difference of two exponentials is Laplace, and reads no draw twice
    return (F.log(1 - F.rand()) - F.log(1 - F.rand())) * F.lit(sensitivity / epsilon)

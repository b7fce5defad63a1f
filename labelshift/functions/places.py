"""Places of values among sorted cut points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Test = Callable[[Column, Column], Column]


def with_place(
    frame: DataFrame,
    value: Column,
    cuts: Column,
    most: int,
    name: str,
    passed: Test = lambda cut, value: cut < value,
) -> DataFrame:
    """Add the number of leading cuts that the value has passed, by halving; ``most`` cuts at most.

    Each halving is a projection of its own. As one nested expression the generated code repeats
    every step in all later ones, grows past what the JVM compiles, and is interpreted for each row.
    """
    held = f"{name}_of"
    placed = frame.withColumns({held: value, name: F.lit(0)})
    step = 1 << most.bit_length() >> 1
    while step:
        cut = F.get(cuts, F.col(name) + (step - 1))
        placed = placed.withColumn(name, F.col(name) + F.when(passed(cut, F.col(held)), step).otherwise(0))
        step >>= 1
    return placed.drop(held)

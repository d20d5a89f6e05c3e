"""Landed records that every text operator is tried on: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

SCHEMA = "coin_id bigint, body string, kept boolean, h bigint, spans string, `text.size` int, id string, row int"
LONG = " ".join(f"payload{i} of the long record" for i in range(4000))


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward() -> list[tuple]:
    rng = random.Random(7)
    plain = words(rng, 60)
    bodies = [
        (1, plain),
        (2, plain),
        (2, plain),
        (3, f"  {plain}\n"),
        (None, plain),
        (None, None),
        (4, None),
        (5, ""),
        (6, " \t\n"),
        (7, "a"),
        (8, "ärmel 日本語 😀 ok"),
        (9, LONG),
        (10, LONG + " and more"),
        (11, plain.replace("w1", "W1", 1) + " tail"),
        (12, words(rng, 90)),
        (13, "!!! ... ---"),
    ]
    return [(k, b, None if i % 3 else True, i, None, i, "x", None) for i, (k, b) in enumerate(bodies)]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA).repartition(3)


def records(spark, bodies: dict):
    return spark.createDataFrame(list(bodies.items()), "coin_id bigint, body string").repartition(3)

"""Registry and shared base views.

A base view is one SELECT both engines understand, so a query and its check start from
the same rows and differ in how the operator itself is computed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadhap.functions import sequence as sq

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


class Tables:
    """Tables of one folder; ``view`` runs a base SELECT on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._stages: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """An intermediate table several parts of one query read: planned once, so that equal exchanges are reused."""
        if name not in self._stages:
            self._stages[name] = build()
        return self._stages[name]

    def view(self, select: str) -> DataFrame:
        used = {t: getattr(self, t) for t in TABLES if "{%s}" % t in select}
        return self.spark.sql(select, **used)


def plain(select: str) -> str:
    """The base SELECT for an engine that has the tables as views."""
    for t in TABLES:
        select = select.replace("{%s}" % t, t)
    return select


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        REGISTRY[name] = Entry(lambda spark, folder: fn(Tables(spark, folder)), sql)
        return fn

    return register


def with_(final: str, **ctes: str) -> str:
    """``WITH a AS (…), b AS (…) final``; CTE order is argument order."""
    return "WITH " + ",\n".join(f"{n} AS ({plain(s)})" for n, s in ctes.items()) + "\n" + final


def micro(col, scale: float = 1e6):
    """A double as a rounded integer, which both engines print alike."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c * F.lit(float(scale)) + F.lit(0.5)).cast("bigint")


def micro_sql(expr: str, scale: str = "1000000.0") -> str:
    return f"cast(floor(({expr}) * cast({scale} as double) + 0.5) as bigint)"


# Letters become bases so that text exercises the sequence operators; j, q, x and z become N.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = "".join("N" if c in "jqxz" else "ACGT"[i % 4] for i, c in enumerate(LETTERS))


def as_sequence(text: str = "text"):
    return sq.lettered(F.col(text), LETTERS + LETTERS.upper(), BASES + BASES)


def as_sequence_sql(text: str = "text") -> str:
    return f"translate(regexp_replace({text}, '[^A-Za-z]', '', 'g'), '{LETTERS + LETTERS.upper()}', '{BASES + BASES}')"


def kmer_rows_sql(source: str, keep: str, k: int, seq: str = "seq") -> str:
    """Every k-mer occurrence without N; sequences are cut into overlapping pieces first."""
    pieces = f"SELECT {keep}, substr({seq}, unnest(range(1, length({seq}) - {k} + 2, 256)), {255 + k}) AS p_ FROM {source} WHERE length({seq}) >= {k}"
    words = f"SELECT {keep}, substr(p_, unnest(range(1, length(p_) - {k} + 2)), {k}) AS kmer FROM ({pieces})"
    return f"SELECT {keep}, kmer FROM ({words}) WHERE NOT contains(kmer, 'N')"


def revcomp_sql(seq: str) -> str:
    return f"reverse(translate({seq}, 'ACGTN', 'TGCAN'))"

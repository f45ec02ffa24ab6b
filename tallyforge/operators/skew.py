"""Joins in which one key may hold a third of all rows of one side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one in SHARE of the rows; so at most SHARE keys are.
SHARE = 100


def hot_keys(df: DataFrame, key: str, share: int = SHARE) -> list:
    """The hot keys, at most ``share`` of them whatever the size."""
    return counted(df, key, share)[1]


def counted(df: DataFrame, key: str, share: int = SHARE) -> tuple[int, list]:
    """Rows, and hot keys: one pass in which each task keeps a sketch of bounded size.

    The sketch holds every key of more than one in 2,000 rows and its count to within that error, so none that is hot is
    missed; one just below may be among them, which does no harm.
    """
    total, there, top = df.agg(F.count("*"), F.count(key), F.expr(f"approx_top_k(`{key}`, {share}, 10000)")).first()
    return total, sorted(x["item"] for x in top or [] if x["item"] is not None and x["count"] * share * 1.05 > there)


def join(many: DataFrame, one: DataFrame, many_key: str, one_key: str, hot: list, how: str = "inner", nulls: bool = False) -> DataFrame:
    """Inner or left join of ``many`` (a written table, as it is read twice where keys are hot) with the unique keys of ``one``.

    Rows of hot keys, and with ``nulls`` those without a key, stay where they are: the rows of ``one`` they meet, at most
    SHARE, are sent to them.
    """
    if not hot and not nulls:
        return many.join(one, many[many_key] == one[one_key], how)
    stays = F.coalesce(F.col(many_key).isin(hot), F.lit(nulls))
    few = F.broadcast(one.filter(F.col(one_key).isin(hot)))  # one row for each hot key
    a, b = many.filter(stays), many.filter(~stays)
    return a.join(few, F.col(many_key) == F.col(one_key), how).unionByName(b.join(one, F.col(many_key) == F.col(one_key), how))

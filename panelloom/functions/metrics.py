"""Forecast error as aggregate columns, so that any grouping pools numerators before dividing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions.exprs import ratio

EPS = 1e-8
SIX = ("wape", "mae", "mse", "rmse", "mape", "smape")


def abs_error(y: Column, yhat: Column) -> Column:
    return F.sum(F.abs(y - yhat))


def wape(y: Column, yhat: Column) -> Column:
    return ratio(abs_error(y, yhat), F.sum(F.abs(y)))


def mse(y: Column, yhat: Column) -> Column:
    return F.avg((y - yhat) * (y - yhat))


def mape(y: Column, yhat: Column) -> Column:
    return F.avg(F.abs(y - yhat) / F.greatest(F.abs(y), F.lit(EPS)))


def smape(y: Column, yhat: Column) -> Column:
    return F.avg(F.lit(2.0) * F.abs(y - yhat) / F.greatest(F.abs(y) + F.abs(yhat), F.lit(EPS)))


def six(y: Column, yhat: Column) -> dict[str, Column]:
    return {
        "wape": wape(y, yhat),
        "mae": F.avg(F.abs(y - yhat)),
        "mse": mse(y, yhat),
        "rmse": F.sqrt(mse(y, yhat)),
        "mape": mape(y, yhat),
        "smape": smape(y, yhat),
    }


def zero_aware(y: Column, yhat: Column) -> dict[str, Column]:
    """The six metrics with the fields a target containing zeros needs.

    MAPE is undefined as soon as one scored row is zero; sMAPE then mostly counts zero rows, and
    ``smape_zero_share`` says how much of it they are.
    """
    zero = F.avg((y == 0).cast("double"))
    any_zero = F.max((y == 0).cast("int")) == 1
    out = six(y, yhat)
    s = out["smape"]
    out["mape"] = F.when(~any_zero, out["mape"])
    out["zero_frac"] = F.round(zero, 6)
    out["mape_nonzero"] = F.when(any_zero, F.avg(F.when(y != 0, F.abs(y - yhat) / y)))
    out["smape_zero_share"] = F.when(any_zero, F.round(ratio(F.lit(2.0) * zero, s), 4))
    return out


def named(metrics: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in metrics.items()]


def long_members(df: DataFrame, members: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Wide member columns to (member, yhat) rows; the member list is a short list of columns."""
    pairs = F.array(*(F.struct(F.lit(m).alias("member"), F.col(m).alias("yhat")) for m in members))
    return df.select(*keep, F.explode(pairs).alias("_m")).select(*keep, "_m.member", "_m.yhat")

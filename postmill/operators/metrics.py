"""Scoring predictions against labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import schemas as S


def split_labelled(df: DataFrame, item: str = "item_id", truth: str = "evaluation") -> tuple[DataFrame, DataFrame]:
    """Labelled rows as an input table (truth removed) and a truth table, both with the item id."""
    return df.drop(truth), df.select(item, F.col(f"{truth}.*"))


def pair_labels(truth: DataFrame, predicted: DataFrame, item: str = "item_id", error: str | None = "error") -> DataFrame:
    """Truth and prediction side by side; failed predictions are left out."""
    fields_t = [c for c in truth.columns if c != item]
    ok = predicted.filter(~F.coalesce(F.col(error), F.lit(False))) if error and error in predicted.columns else predicted
    fields_p = [c for c in ok.columns if c != item and c in fields_t]
    return truth.select(item, *[F.col(c).alias(f"t_{c}") for c in fields_t]).join(
        ok.select(item, *[F.col(c).alias(f"p_{c}") for c in fields_p]), item
    )


def label_pairs(
    paired: DataFrame,
    boolean: Sequence[str] = S.BOOLEAN_FIELDS,
    categorical: Sequence[str] = ("job_level",),
    item: str = "item_id",
) -> DataFrame:
    """Long form (item, field, is_boolean, truth, pred); fields missing on either side are skipped."""
    rows = [
        F.struct(
            F.lit(f).alias("field"),
            F.lit(f in boolean).alias("is_boolean"),
            F.col(f"t_{f}").cast("string").alias("truth"),
            F.col(f"p_{f}").cast("string").alias("pred"),
        )
        for f in [*boolean, *categorical]
    ]
    long = paired.select(item, F.inline(F.array(*rows)))
    return long.filter(F.col("truth").isNotNull() & F.col("pred").isNotNull())


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def field_scores(pairs: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1 and confusion counts per field, plus the pooled boolean row.

    The pairs are aggregated once to one row per field; the pooled row is summed from those rows.
    A field named in ``fields`` that has no pairs gets zeros. Categories get accuracy only.
    """
    t, p = F.col("truth") == "true", F.col("pred") == "true"
    counts = pairs.groupBy("field", "is_boolean").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("truth") == F.col("pred")).alias("hits"),
        F.count_if(F.col("is_boolean") & t & p).alias("tp"),
        F.count_if(F.col("is_boolean") & ~t & p).alias("fp"),
        F.count_if(F.col("is_boolean") & t & ~p).alias("fn"),
        F.count_if(F.col("is_boolean") & ~t & ~p).alias("tn"),
    )
    sums = ("n", "hits", "tp", "fp", "fn", "tn")
    pooled = (
        counts.filter("is_boolean")
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])
        .select(F.lit("overall").alias("field"), F.lit(True).alias("is_boolean"), *sums)
    )
    table = counts.unionByName(pooled)
    if fields is not None:
        names = F.explode(F.array(*[F.lit(f) for f in fields]))
        wanted = counts.sparkSession.range(1).select(names.alias("field"))
        missing = wanted.join(counts, "field", "left_anti").select(
            "field", F.lit(None).cast("boolean").alias("is_boolean"), *[F.lit(0).cast("long").alias(c) for c in sums]
        )
        table = table.unionByName(missing)
    precision = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return table.select(
        "field",
        "n",
        _ratio(F.col("hits"), F.col("n")).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn")).alias("f1"),
        "tp", "fp", "fn", "tn",
    )


def mismatches(
    paired: DataFrame, fields: Sequence[str] = S.EVAL_FIELDS, item: str = "item_id"
) -> DataFrame:
    """Items with a wrong field, each with "field: got=... expected=..." in field order. No shuffle."""
    notes = [
        F.when(
            F.col(f"t_{f}").isNotNull() & F.col(f"p_{f}").isNotNull() & (F.col(f"t_{f}") != F.col(f"p_{f}")),
            F.concat(
                F.lit(f"{f}: got="), F.col(f"p_{f}").cast("string"), F.lit(" expected="), F.col(f"t_{f}").cast("string")
            ),
        )
        for f in fields
    ]
    return paired.select(item, F.concat_ws("; ", *notes).alias("misses")).filter(F.col("misses") != "")


def gate(scores: DataFrame, threshold: float = S.ACCURACY_GATE) -> DataFrame:
    """One row: does the pooled accuracy reach the threshold?"""
    return scores.filter(F.col("field") == "overall").select(
        "accuracy", F.lit(threshold).alias("threshold"), (F.col("accuracy") >= threshold).alias("passed")
    )

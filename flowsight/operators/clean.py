"""Column names, required columns, numeric coercion and invalid rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsight.functions.scalars import finite_or, number
from flowsight.schema import FEATURES

# Columns that are never model inputs.
NOT_FEATURES = ["label", "uniq_src", "uniq_dst"]


def normalize_columns(df: DataFrame) -> DataFrame:
    """Column names trimmed, inner spaces as underscores."""
    return df.toDF(*[c.strip().replace(" ", "_") for c in df.columns])


def missing_features(df: DataFrame, features: Sequence[str] = FEATURES) -> list[str]:
    return [c for c in features if c not in df.columns]


def require_features(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    missing = missing_features(df, features)
    if missing:
        raise ValueError(f"missing feature columns: {', '.join(missing)}")
    return df


def to_numeric(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Feature cells as doubles; what does not parse becomes null."""
    return df.withColumns({c: number(F.col(c)) for c in features})


def clean_features(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Numeric features, without the rows where one is missing, NaN or malformed."""
    return to_numeric(require_features(df, features), features).na.drop(subset=list(features))


def malformed_count(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """One row: rows read, and rows :func:`clean_features` drops."""
    parsed = to_numeric(df, features)
    bad = F.lit(False)
    for c in features:
        bad = bad | F.col(c).isNull() | F.isnan(c)
    return parsed.agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("dropped"))


def prepare_features(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Evaluation input: absent features, nulls, NaN and infinities are 0."""
    df = normalize_columns(df)
    zero = F.lit(0.0)
    return df.withColumns(
        {c: finite_or(F.col(c).cast("double"), zero) if c in df.columns else zero for c in features}
    )


def drop_invalid(df: DataFrame) -> DataFrame:
    """Rows without null, NaN or infinite cells."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    null = F.lit(None).cast("double")
    return df.withColumns({c: finite_or(F.col(c), null) for c in floats}).na.drop()


def core_columns(df: DataFrame, label: str = "label") -> DataFrame:
    """The model features and the label, as far as they exist."""
    return df.select([c for c in [*FEATURES, label] if c in df.columns])


def select_feature_columns(df: DataFrame, excluded: Iterable[str] = NOT_FEATURES) -> list[str]:
    """Names of the numeric columns a model may use, in table order."""
    left_out = set(excluded)
    return [
        f.name for f in df.schema if f.name not in left_out and isinstance(f.dataType, T.NumericType)
    ]


def add_missing_features(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Absent features as 0; cells that are there stay as they are."""
    return df.withColumns({c: F.lit(0) for c in missing_features(df, features)})

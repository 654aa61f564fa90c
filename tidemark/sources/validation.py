"""Row contracts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def contract_errors(df: DataFrame, contract: T.StructType) -> Column:
    """Array of messages, one per broken field: missing value or wrong type."""
    checks = []
    for field in contract.fields:
        name, kind = field.name, field.dataType.simpleString()
        if name not in df.columns:
            if not field.nullable:
                checks.append(F.lit(f"{name}: missing column"))
            continue
        col = F.col(f"`{name}`")
        if not field.nullable:
            checks.append(F.when(col.isNull(), F.lit(f"{name}: required")))
        if df.schema[name].dataType != field.dataType:
            if isinstance(field.dataType, (T.StructType, T.ArrayType)):
                checks.append(F.lit(f"{name}: not {kind}"))
            else:
                bad = col.isNotNull() & col.cast("string").try_cast(kind).isNull()
                checks.append(F.when(bad, F.lit(f"{name}: not {kind}")))
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def validate_rows(df: DataFrame, contract: T.StructType, *, with_file: bool = False) -> DataFrame:
    """Every row with its list of contract errors (and its file)."""
    out = df.withColumn("errors", contract_errors(df, contract))
    return out.withColumn("file", F.input_file_name()) if with_file else out


def validation_counts(checked: DataFrame) -> DataFrame:
    """Total and valid rows."""
    return checked.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(F.size("errors") == 0).alias("valid_rows")
    )


def log_errors(df: DataFrame, required: list[str]) -> DataFrame:
    """Log lines with their contract errors; nested fields use dots."""
    checks = [F.when(F.col("_corrupt").isNotNull(), F.lit("line: not valid JSON"))]
    checks += [F.when(F.col(c).isNull(), F.lit(f"{c.replace('`', '')}: required")) for c in required]
    return df.withColumn("errors", F.array_compact(F.array(*checks)))

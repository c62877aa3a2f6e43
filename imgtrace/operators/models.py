"""Model specifications from configuration rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgtrace.schema import MODEL_KINDS

# --- fixed values ---------------------------------------------------------
REQUIRED = ("id", "kind", "backend", "checkpoint", "vector_size")
DEFAULT_INPUT_SIZE = 224
# --------------------------------------------------------------------------


def parse_model_specs(raw: DataFrame, text: str = "spec") -> DataFrame:
    """JSON objects -> typed specs with `fault` (NULL = valid).

    First fault that applies: missing fields, kind, vector_size, input_size,
    duplicate id.
    """
    spec = raw.withColumn("_m", F.from_json(F.col(text), "map<string,string>"))
    size = lambda c: F.expr(f"try_cast(_m['{c}'] AS INT)")
    has_all = F.lit(True)
    for f in REQUIRED:
        has_all = has_all & F.map_contains_key("_m", f)
    typed = spec.select(
        *[c for c in raw.columns if c != text],
        F.col("_m")["id"].alias("id"), F.col("_m")["kind"].alias("kind"),
        F.col("_m")["backend"].alias("backend"), F.col("_m")["checkpoint"].alias("checkpoint"),
        size("vector_size").alias("vector_size"),
        F.coalesce(size("input_size"), F.lit(DEFAULT_INPUT_SIZE)).alias("input_size"),
        F.coalesce(has_all, F.lit(False)).alias("_all"))
    copies = typed.where("_all").groupBy("id").agg(F.count("*").alias("_n"))
    fault = (
        F.when(~F.col("_all"), "missing fields")
        .when(~F.coalesce(F.col("kind").isin(*MODEL_KINDS), F.lit(False)), "kind")
        .when(F.coalesce("vector_size", F.lit(0)) < 1, "vector_size")
        .when(F.col("input_size") < 1, "input_size")
        .when(F.col("_n") > 1, "duplicate id")
    )
    return typed.join(copies, "id", "left").withColumn("fault", fault).drop("_all", "_n")


def accept_specs(specs: DataFrame) -> DataFrame:
    """The specs if there is at least one and none is faulty; raises otherwise."""
    bad = specs.where(F.col("fault").isNotNull()).take(1)
    if bad:
        raise ValueError(f"model spec refused: {bad[0]['fault']}")
    if specs.isEmpty():
        raise ValueError("at least one model must be configured")
    return specs.drop("fault")

"""Trial catalogue from nested manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACEHOLDER = r"\$\{([^}]+)\}"


def trial_catalogue(manifests: DataFrame) -> DataFrame:
    """One row per (subject, subset, trial) with the inherited manifest columns.

    ``trials`` is a map from subset to an array of trial structs."""
    rest = [c for c in manifests.columns if c != "trials"]
    d = manifests.select(*rest, F.posexplode(F.map_entries("trials")).alias("subset_pos", "_s"))
    d = d.select(*rest, "subset_pos", F.col("_s.key").alias("subset"),
                 F.posexplode("_s.value").alias("trial_pos", "_t"))
    return d.select(*rest, "subset_pos", "subset", "trial_pos", "_t.*")


def variable_map(variables: DataFrame) -> DataFrame:
    """One row holding all variables; the table has a handful of rows."""
    return variables.agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("_vars"))


def resolve(text: Column, variables: Column) -> Column:
    """Replace every ``${name}``; NULL when one of them is unknown."""
    names = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(1))
    return F.aggregate(
        names, text,
        lambda acc, n: F.replace(acc, F.concat(F.lit("${"), n, F.lit("}")), F.try_element_at(variables, n)),
    )


def resolve_columns(
    df: DataFrame, variables: DataFrame, columns: list[str], root: str | None = None, strict: bool = False
) -> DataFrame:
    """Resolve placeholders in string columns. ``root`` names the column that
    defines ``paths.root`` per row and is resolved first. Adds ``unresolved``
    with the columns that could not be resolved; ``strict`` raises instead."""
    d = df.withColumn("_vars", variable_map(variables).scalar())  # one row
    if root:
        d = d.withColumn("_root", resolve(F.col(root), F.col("_vars")))
        d = d.withColumn("_vars", F.when(
            F.col("_root").isNotNull(),
            F.map_concat("_vars", F.create_map(F.lit("paths.root"), F.col("_root")))).otherwise(F.col("_vars")))
    for c in columns:
        d = d.withColumn(f"_r_{c}", resolve(F.col(c), F.col("_vars")))
    bad = F.filter(
        F.array(*[F.when(F.col(c).isNotNull() & F.col(f"_r_{c}").isNull(), F.lit(c)) for c in columns]),
        lambda x: x.isNotNull(),
    )
    out = d.select(*[F.col(f"_r_{c}").alias(c) if c in columns else F.col(c) for c in df.columns], bad.alias("unresolved"))
    if strict:
        fail = F.raise_error(F.concat(F.lit("unresolved placeholder in "), F.array_join("unresolved", ",")))
        out = out.withColumn("unresolved", F.when(F.size("unresolved") > 0, fail.cast("array<string>")).otherwise(F.col("unresolved")))
    return out


def output_dir(df_root: str = "/out", leaf: Column | None = None) -> Column:
    """Explicit output folder, else root/subject/session/camera; then the trial id."""
    base = F.coalesce(
        F.col("output_dir"),
        F.concat_ws("/", F.lit(df_root), F.coalesce("subject_id", F.lit("subject")),
                    F.coalesce("session", F.lit("Session")), F.coalesce("camera", F.lit("Cam"))),
    )
    parts = [base, F.col("id")] + ([leaf] if leaf is not None else [])
    return F.concat_ws("/", *parts)

"""Traits, species lists, file matching and dispersal statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..config import DISPLAY_NAMES, EUCLIDEAN, GROUPS, HABITATS, SENSITIVITIES


def clean_strings(df: DataFrame) -> DataFrame:
    """'/' becomes '_' in every string column; a missing string becomes the text nan."""
    return df.withColumns({f.name: F.coalesce(F.translate(F.col(f"`{f.name}`"), "/", "_"), F.lit("nan")) for f in df.schema.fields if isinstance(f.dataType, T.StringType)})


def first_rows(traits: DataFrame, order: str = "species_id") -> DataFrame:
    """The first row of each species in file order: later ones never count in lookups. One partial aggregate, no sort."""
    rest = [c for c in traits.columns if c not in ("species", order)]
    first = traits.groupBy("species").agg(F.min_by(F.struct(*rest), order).alias("first"))
    return first.select("species", "first.*")


def lookup(traits: DataFrame, species: str, key: str):
    """One species' value; raises where the species or the column is missing."""
    if key not in traits.columns:
        raise KeyError(f"traits have no column {key}")
    row = traits.where(F.col("species") == species).orderBy("species_id").select(key).first()
    if row is None:
        raise LookupError(f"traits have no species {species}")
    return row[0]


def group_species(traits: DataFrame, group: str) -> DataFrame:
    """Species of a group, repeated ones included."""
    return traits.where(F.col("grp") == group).select("species_id", "species")


def species_in_habitat(traits: DataFrame) -> DataFrame:
    """Species rows of each group whose first row lies in the habitat: (habitat, grp, species_id, species)."""
    first = first_rows(traits).select("species", F.col("habitat").alias("first_habitat"))
    joined = traits.join(first, "species").where(F.col("first_habitat").isin(*HABITATS))
    return joined.select(F.col("first_habitat").alias("habitat"), "grp", "species_id", "species")


def match_files(traits: DataFrame, files: DataFrame, name: str = "species", suffix: str = "_reg_covariate_ensemble.tif") -> DataFrame:
    """(species_id, species, n_files, file) where file is set only if exactly one file name ends in the dotted species name.

    The suffix match is an equi-join: every ending of a file's stem that is as
    long as some wanted name is made, so no pair of a species and a file is
    tested that doesn't match. Files are dealt over all tasks before, as a small
    file of names makes many endings, and the join is a merge: what names and
    endings take in memory can't be told from the size of the tables' files.
    """
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stems = files.where(F.col("file").endswith(suffix)).withColumn("stem", F.expr(f"left(file, length(file) - {len(suffix)})")).repartition(tasks, "file")
    wanted = traits.select("species_id", "species", F.replace(F.col(name), F.lit(" "), F.lit(".")).alias("ending"))
    sizes = F.broadcast(wanted.agg(F.collect_set(F.length("ending")).alias("sizes")))  # one row: the few lengths that names have
    endings = stems.crossJoin(sizes).select("file", F.explode(F.expr("transform(filter(sizes, n -> n <= length(stem)), n -> right(stem, n))")).alias("ending"))
    # files are counted by ending before they meet names: a name that repeats in both makes no pairs
    endings = endings.groupBy("ending").agg(F.count("*").alias("n"), F.min("file").alias("file"))
    found = wanted.join(endings.hint("merge"), "ending", "left").groupBy("species_id", "species").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"), F.min("file").alias("file"))
    return found.withColumn("file", F.when(F.col("n_files") == 1, F.col("file")))


def available(matched: DataFrame) -> DataFrame:
    return matched.where("n_files = 1")


def available_report(traits: DataFrame, files: DataFrame) -> DataFrame:
    """(habitat, grp, species, dispersal_range_km) of species with exactly one file; habitat and range are those of the species' first row."""
    first = first_rows(traits).select("species", F.col("habitat").alias("__habitat"), F.col("dispersal_km").alias("dispersal_range_km"))
    found = available(match_files(traits, files)).select("species_id").distinct()
    rows = traits.join(found.hint("merge"), "species_id", "left_semi").join(first.hint("merge"), "species")  # as many rows as species
    return rows.select(F.col("__habitat").alias("habitat"), "grp", "species", "dispersal_range_km")


def dispersal_stats(traits: DataFrame) -> DataFrame:
    """Count, exact median and sample deviation (metres) of dispersal by group and habitat."""
    out = traits.groupBy("habitat", "grp").agg(F.count("*").alias("n_species"), (F.median("dispersal_km") * 1000).alias("d_m"), (F.stddev_samp("dispersal_km") * 1000).alias("d_m_std"))
    return out


def species_list(traits: DataFrame) -> DataFrame:
    return traits.groupBy("habitat", "grp").agg(F.array_sort(F.collect_list("species")).alias("species"))


def group_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(GROUPS.items()), "grp string, distance string")


def display_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DISPLAY_NAMES.items()), "grp string, display_name string")


def job_matrix(groups: DataFrame) -> DataFrame:
    """Every group with every habitat; both sides have a fixed few rows."""
    habitats = F.explode(F.array(*[F.lit(h) for h in HABITATS])).alias("habitat")
    return groups.select("grp", "distance", habitats)


def tasks(jobs: DataFrame) -> DataFrame:
    """Jobs by sensitivity; permeability has no meaning for straight-line distance."""
    every = jobs.select("*", F.explode(F.array(*[F.lit(s) for s in SENSITIVITIES])).alias("sens"))
    return every.where(~((F.col("distance") == EUCLIDEAN) & (F.col("sens") == "permeability")))


def progress(jobs: DataFrame, batch: int = 6) -> DataFrame:
    """Batch number and percentage done after each job, jobs in order."""
    total = len(GROUPS) * len(HABITATS)
    nth = F.row_number().over(Window.orderBy("grp", "habitat"))
    return jobs.withColumn("nth", nth).withColumn("batch", F.expr(f"(nth - 1) div {batch}")).withColumn("percent", F.expr(f"nth * 100 div {total}"))

"""Selections (sets of paths), directory trees, token totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors
from ..functions.text import estimated_tokens

KEY = ["project_id", "path"]


def add(selected: DataFrame, more: DataFrame) -> DataFrame:
    """U3, U9"""
    return selected.select(*KEY).union(more.select(*KEY)).distinct()


def remove(selected: DataFrame, gone: DataFrame) -> DataFrame:
    """U4"""
    return selected.select(*KEY).distinct().join(gone.select(*KEY).distinct(), KEY, "left_anti")


def invert(selected: DataFrame, universe: DataFrame) -> DataFrame:
    """The rest of the universe."""
    return remove(universe, selected)


def toggle(selected: DataFrame, subtree: DataFrame) -> DataFrame:
    """If all of the subtree is selected it goes, else what is missing comes."""
    missing = remove(subtree, selected).limit(1)
    state = F.broadcast(missing.agg((F.count(F.lit(1)) == 0).alias("all_in")))  # one row
    kept = selected.select(*KEY).distinct().join(subtree.select(*KEY).distinct().withColumn("inside", F.lit(True)), KEY, "left").join(state)
    return kept.where("inside is null or not all_in").select(*KEY).union(remove(subtree, selected).join(state).where("not all_in").select(*KEY)).distinct()


def under(files: DataFrame, directory: str) -> DataFrame:
    """U12, S17"""
    return files.where(F.startswith("path", F.lit(directory.rstrip("/") + "/")))


def closure(files: DataFrame) -> DataFrame:
    """Files and all their directories."""
    return files.select("project_id", F.explode(F.array_append(F.filter(ancestors(F.col("path")), lambda p: p != ""), F.col("path"))).alias("path")).distinct()


def directories(files: DataFrame) -> DataFrame:
    """U7"""
    return remove(closure(files), files)


def tree(files: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """(project_id, node, depth, size, n_files, state) of every directory; "" is the project; state is none, mixed or all.

    Sizes are added up per prefix; the root of a hot project is pre-aggregated in each task.
    """
    marked = files.select(*KEY, "size", F.lit(0).alias("s")) if selected is None else files.join(selected.select(*KEY).distinct().withColumn("s", F.lit(1)), KEY, "left").select(*KEY, "size", F.coalesce("s", F.lit(0)).alias("s"))
    summed = marked.select("project_id", F.explode(ancestors(F.col("path"))).alias("node"), "size", "s").groupBy("project_id", "node").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n_files"), F.sum("s").alias("n_selected"))
    state = F.when(F.col("n_selected") == 0, "none").when(F.col("n_selected") == F.col("n_files"), "all").otherwise("mixed")
    depth = F.when(F.col("node") == "", 0).otherwise(F.size(F.split("node", "/")))
    return summed.select("project_id", "node", depth.alias("depth"), "size", "n_files", state.alias("state"))


def tree_order(nodes: DataFrame, by: str = "name") -> DataFrame:
    """Directories before files, by name or by falling size."""
    return nodes.orderBy("project_id", F.col("kind") != "directory", *([F.desc("size")] if by == "size" else []), F.collate("node", "UNICODE"), "node")


def token_stats(files: DataFrame, limit: int | None = None) -> DataFrame:
    """One row (n_files, size, tokens of the sum, sum of the files' tokens, over_limit)."""
    out = files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("size"), F.coalesce(F.sum(estimated_tokens(F.col("size"))), F.lit(0)).cast("long").alias("file_tokens"))
    out = out.withColumn("tokens", estimated_tokens(F.col("size")))
    return out.withColumn("over_limit", F.col("tokens") > F.lit(limit if limit is not None else 2**62))


def load_preset(preset: DataFrame, files: DataFrame, exclude: str | None) -> DataFrame:
    """The preset's paths that exist and aren't excluded."""
    there = files.select(*KEY) if exclude is None else files.select(*KEY).where(~F.col("path").rlike(exclude))
    return preset.select(*KEY).distinct().join(there, KEY, "left_semi")


def candidate_tree(candidates: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_id, name, kind, node, size, n_files) of projects, directories and files; candidates of unknown projects get a project of their id, known projects without candidates stay."""
    dirs = tree(candidates).select("project_id", "node", "size", "n_files").withColumn("kind", F.when(F.col("node") == "", "project").otherwise("directory"))
    leaves = candidates.select("project_id", F.col("path").alias("node"), "size", F.lit(1).cast("long").alias("n_files"), F.lit("file").alias("kind"))
    known = projects.select(F.col("id").alias("project_id"), F.col("name").alias("p_name"))
    empty = known.join(candidates.select("project_id").distinct(), "project_id", "left_anti").select("project_id", F.lit("").alias("node"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("n_files"), F.lit("project").alias("kind"))
    nodes = dirs.unionByName(leaves).unionByName(empty).join(known, "project_id", "left")
    return nodes.select("project_id", F.when(F.col("kind") == "project", F.coalesce("p_name", "project_id")).otherwise(F.element_at(F.split("node", "/"), -1)).alias("name"), "kind", "node", "size", "n_files")


def favourites(candidates: DataFrame, keys: DataFrame) -> DataFrame:
    """the candidates whose key is a favourite."""
    return candidates.join(keys.select(*KEY).distinct(), KEY, "left_semi")


def valid_contents(files: DataFrame) -> DataFrame:
    """(project_id, n_valid): files with a text that isn't empty."""
    return files.groupBy("project_id").agg(F.count_if(F.length("text") > 0).alias("n_valid"))

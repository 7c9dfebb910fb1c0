"""Dataset names to pinned storage locations."""

from __future__ import annotations

from pyspark.sql import DataFrame


def resolve_dataset(
    names: DataFrame, datasets: DataFrame, current: DataFrame, pointers: DataFrame, versions: DataFrame
) -> DataFrame:
    """``dataset_name -> dataset_uuid -> current dataset_version -> location``.

    ``datasets``: dataset_name, dataset_uuid, dag_name. ``current``: dag_name, dag_version.
    ``pointers``: dag_version, dataset_uuid, dataset_version. ``versions``:
    dataset_version, storage_prefix, storage_glob. Unpublished names give no row.
    """
    return (
        names.select("dataset_name")
        .join(datasets.select("dataset_name", "dataset_uuid", "dag_name"), "dataset_name")
        .join(current.select("dag_name", "dag_version"), "dag_name")
        .join(pointers.select("dag_version", "dataset_uuid", "dataset_version"), ["dag_version", "dataset_uuid"])
        .join(versions.select("dataset_version", "storage_prefix", "storage_glob"), "dataset_version")
        .select("dataset_name", "dataset_uuid", "dataset_version", "storage_prefix", "storage_glob")
    )

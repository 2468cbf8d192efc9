"""Lineage cuts, table paths in the shared folder that the cluster names, and row numbers."""

from pyspark.sql import DataFrame

from tidemark.operators.lineage import cut, fresh_folder, numbered, shared_folder

__all__ = ["cut", "fresh_folder", "numbered", "shared_folder", "unused"]


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that `df` doesn't have, in whatever case."""
    taken, tail = {c.lower() for c in df.columns}, ""
    while any(f"__{n}{tail}".lower() in taken for n in names):
        tail += "_"
    return [f"__{n}{tail}" for n in names]

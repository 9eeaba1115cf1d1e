"""Dataset bundles and feature joins.

A ``Bundle`` is an immutable holder of lazy DataFrames plus the contract.
Re-splitting returns a new bundle, so cached scores keyed by the bundle
version can never be stale (X9).
"""

from __future__ import annotations

import dataclasses
import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklab.operators.validate import ContractViolation, check_user_overlap, has_duplicate_keys
from ranklab.plans.contracts import contract_from_columns, dataset_type

_versions = itertools.count(1)


@dataclasses.dataclass(frozen=True)
class Bundle:
    interactions: DataFrame
    contract: str
    users: DataFrame | None = None
    items: DataFrame | None = None
    valid: DataFrame | None = None
    test: DataFrame | None = None
    version: int = dataclasses.field(default_factory=lambda: next(_versions))

    @property
    def dataset_type(self) -> str:
        return dataset_type(self.contract)

    def with_splits(self, split_df: DataFrame) -> "Bundle":
        """A re-split is a new bundle (new version); the old test split is gone."""
        return dataclasses.replace(
            self, interactions=split_df.filter(F.col("split") == "train").drop("split"),
            valid=split_df.filter(F.col("split") == "valid").drop("split"),
            test=split_df.filter(F.col("split") == "test").drop("split"),
            version=next(_versions))


def join_user_features(inter: DataFrame, users: DataFrame, how: str = "left", check_unique: bool = True) -> DataFrame:
    """Equi join on USER_ID. Users must be unique (else rows fan out),
    which is checked with a stop-at-first-duplicate probe. The planner picks a
    broadcast only when the users table is under the broadcast threshold."""
    if check_unique and has_duplicate_keys(users, "USER_ID"):
        raise ContractViolation("users table has duplicate USER_ID; joining would duplicate interactions")
    return inter.join(users, "USER_ID", how)


def join_item_features(inter: DataFrame, items: DataFrame, how: str = "left", check_unique: bool = True) -> DataFrame:
    if check_unique and has_duplicate_keys(items, "ITEM_ID"):
        raise ContractViolation("items table has duplicate ITEM_ID; joining would duplicate interactions")
    return inter.join(items, "ITEM_ID", how)


def unmatched_users(inter: DataFrame, users: DataFrame) -> DataFrame:
    """J4 guard: interaction users missing from the users table (anti join)."""
    return inter.select("USER_ID").distinct().join(users.select("USER_ID"), "USER_ID", "left_anti")


def create_bundle(interactions: DataFrame, users: DataFrame | None = None, items: DataFrame | None = None,
                  valid: DataFrame | None = None, test: DataFrame | None = None,
                  merge_users_into_wide: bool = True) -> Bundle:
    """J5 (+ J3, V5): resolve contract, guard overlaps, merge users into wide data."""
    contract = contract_from_columns(interactions.columns)
    if contract == "unknown":
        raise ContractViolation(f"cannot tell the contract of columns {interactions.columns}")
    if users is not None:
        check_user_overlap(interactions, users)
    if contract == "wide_multioutput":
        if items is not None:
            raise ContractViolation("item features cannot be attached to wide multi-output data "
                                    "(there is no ITEM_ID to join on)")
        if users is not None and merge_users_into_wide:
            interactions = join_user_features(interactions, users, "left")
            users = None
    return Bundle(interactions, contract, users, items, valid, test)

"""Versions of a table: folders beside one another, a pointer to the current one, leases of readers.

A version is written whole to a folder of its own and then published by replacing the pointer, so
a reader sees one version or the other. Old versions are removed when newer ones are published,
except those that a reader holds.
"""

import time
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import SparkSession

from basketflow import folders

_POINTER = "_current"
_LEASES = "_leases"


def new_version(number: int) -> str:
    """A folder name that sorts by ``number`` and that no other attempt uses."""
    return f"batch={number:012d}-{uuid4().hex[:8]}"


def current(spark: SparkSession, root: str) -> str | None:
    """The name of the published version; before any, that of the newest complete folder."""
    found = folders.read_text(spark, f"{root}/{_POINTER}")
    if found:
        return found
    complete = [n for n in _versions(spark, root) if folders.exists(spark, f"{root}/{n}/_SUCCESS")]
    return complete[-1] if complete else None


def publish(
    spark: SparkSession, root: str, version: str, keep: int | None = 2, lease_hours: float = 24
) -> None:
    """Make ``version`` the current one, then remove all but the ``keep`` newest (None: keep all).

    Folders of attempts that failed, which have no success mark, go with the old versions. A
    lease holds a version for ``lease_hours`` at most, so that a reader that died does not keep
    it for ever.
    """
    folders.replace_text(spark, f"{root}/{_POINTER}", version)
    if keep is None:
        return
    complete = [n for n in _versions(spark, root) if folders.exists(spark, f"{root}/{n}/_SUCCESS")]
    kept = {version, *complete[-max(keep, 1) :]}
    oldest = time.time() - 3600 * lease_hours
    for lease, changed in folders.entries(spark, f"{root}/{_LEASES}"):
        if changed / 1000 < oldest:
            folders.remove(spark, f"{root}/{_LEASES}/{lease}")
        else:
            kept.add(lease.partition("~")[0])
    for name in _versions(spark, root):
        if name not in kept:
            folders.remove(spark, f"{root}/{name}")


@contextmanager
def held(spark: SparkSession, root: str) -> Iterator[str | None]:
    """The current version's name, which is not removed while the block runs; None before any."""
    while True:
        version = current(spark, root)
        if version is None:
            yield None
            return
        lease = f"{root}/{_LEASES}/{version}~{uuid4().hex}"
        folders.make(spark, lease)
        # Between the look and the lease the version may have been removed.
        if folders.exists(spark, f"{root}/{version}"):
            break
        folders.remove(spark, lease)
    try:
        yield version
    finally:
        folders.remove(spark, lease)


def _versions(spark: SparkSession, root: str) -> list[str]:
    return [name for name in folders.names(spark, root) if name.startswith("batch=")]

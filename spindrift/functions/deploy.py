"""Make this package importable in the Python workers of a session."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

_DONE = "_spindrift_shipped"


def ship(spark) -> None:
    """Send the package's sources to the executors, once for each context. Submitting with --py-files does the same."""
    context = spark.sparkContext
    if getattr(context, _DONE, False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name, top = os.path.basename(root), os.path.dirname(root)
    path = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in sorted(os.walk(root)):
            for file in sorted(files):
                if file.endswith(".py"):
                    out.write(os.path.join(folder, file), os.path.relpath(os.path.join(folder, file), top))
    context.addPyFile(path)
    setattr(context, _DONE, True)


def shipped(query: Callable) -> Callable:
    """The query, with the package sent first."""

    @functools.wraps(query)
    def run(spark, *args, **kwargs):
        ship(spark)
        return query(spark, *args, **kwargs)

    return run

"""Package imports: which sets a site needs and in what order, worked out on the driver before any plan.

Each imported directory is a set of its own. The graph has a node per directory, however often it is
imported; a cycle is an error that names its path.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import extract_imports
from ..operators.docset import DocSet


class ImportCycle(ValueError):
    """Packages that import one another."""


def imported(docs: DataFrame) -> list[tuple[str, str]]:
    """(name, spec) of a set's imports, in the order of their names. One row per import line."""
    rows = docs.select(F.explode(extract_imports(F.col("content"))).alias("i")).select("i.name", "i.spec").distinct()
    return sorted((r.name, r.spec) for r in rows.collect())


def resolve(root: str, spec: str, packages: dict[str, str] | None = None) -> str:
    """The directory a spec names: relative to the importing one, or a known package."""
    if spec.startswith("."):
        return posixpath.normpath(posixpath.join(root, spec))
    if packages and spec in packages:
        return packages[spec]
    raise ValueError(f"unknown package {spec} imported by {root}")


def import_order(root: str, imports_of: Callable[[str], Iterable[str]]) -> list[str]:
    """Directories with those they import first; each once, the root last."""
    order: list[str] = []
    done: set[str] = set()
    path: list[str] = []

    def visit(at: str) -> None:
        if at in path:
            raise ImportCycle(" -> ".join([*path[path.index(at) :], at]))
        if at in done:
            return
        path.append(at)
        for other in imports_of(at):
            visit(other)
        path.pop()
        done.add(at)
        order.append(at)

    visit(root)
    return order


class Site:
    """The sets of a site: `site[directory]` is a DocSet; queries run in one set, never across."""

    def __init__(self, root: str, load: Callable[[str], DocSet], packages: dict[str, str] | None = None):
        self.sets: dict[str, DocSet] = {}
        self.names: dict[str, dict[str, str]] = {}

        def imports_of(at: str) -> list[str]:
            self.sets[at] = load(at)
            self.names[at] = {name: resolve(at, spec, packages) for name, spec in imported(self.sets[at].docs)}
            return list(self.names[at].values())

        self.order = import_order(root, imports_of)
        self.root = root

    def __getitem__(self, directory: str) -> DocSet:
        return self.sets[directory]

    def handle(self, name: str, importer: str | None = None) -> DocSet:
        """The set that a document of `importer` knows by a name."""
        return self.sets[self.names[importer or self.root][name]]

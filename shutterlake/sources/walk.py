"""Folder trees as tables, read by a walk that leaves excluded folders out while it descends.

``FolderWalk`` is a data source: the planner lists the upper levels of the tree
until there are enough folders, and every task walks some of them to the bottom.
Links are not followed. A folder whose path holds an exclusion is neither listed
nor descended to. Filters on ``path`` (a prefix, an equality) and on ``size`` are
pushed to the walk: a prefix leaves out all folders that cannot hold such a path.

``WatchedRoots`` reads the same trees as a stream. Its offset is a moment: a batch
holds the files that were changed after the last one and not after the new one,
so nothing comes twice after a restart, and the announced roots may grow between
batches. The moment lags the clock by ``settle`` seconds, so a file that is being
written is left for a later batch. A file that is moved in with an old date of
change is not seen by a stream; a walk of the whole tree finds it.
"""

from __future__ import annotations

import json
import os
import stat
import time
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

SCHEMA = "path string, size long, modified double"
#: Folders that the planner looks for before it deals them out, and most tasks that a walk has.
ENOUGH, MOST_TASKS = 256, 1024


class Rules:
    """Which folders are walked and which files are taken."""

    def __init__(self, exclusions: list[str], extensions: list[str], prefix: str = "", least: int = 0, most: int | None = None):
        self.exclusions, self.extensions = [e for e in exclusions if e], {e.lower() for e in extensions}
        self.prefix, self.least, self.most = prefix, least, most

    def descends(self, folder: str) -> bool:
        inside = (folder + "/").startswith(self.prefix) or self.prefix.startswith(folder + "/")
        return inside and not any(e in folder for e in self.exclusions)

    def takes(self, path: str, size: int) -> bool:
        name = path.rsplit("/", 1)[1]
        kind = name.rsplit(".", 1)[1].lower() if "." in name else None
        return (not self.extensions or kind in self.extensions) and path.startswith(self.prefix) and self.least <= size and (self.most is None or size <= self.most)


def listed(folder: str, rules: Rules) -> tuple[list[str], list[tuple]]:
    """(folders to descend to, files) of one folder; one that cannot be read is empty."""
    folders, files = [], []
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return folders, files
    for e in entries:
        try:
            info = e.stat(follow_symlinks=False)
        except OSError:  # gone meanwhile
            continue
        if stat.S_ISDIR(info.st_mode):
            if rules.descends(e.path):
                folders.append(e.path)
        elif stat.S_ISREG(info.st_mode) and rules.takes(e.path, info.st_size):
            files.append((e.path, info.st_size, info.st_mtime))
    return folders, files


def below(folder: str, rules: Rules) -> Iterator[tuple]:
    """All files of a tree, by an explicit stack."""
    stack = [folder]
    while stack:
        folders, files = listed(stack.pop(), rules)
        yield from files
        stack += reversed(folders)


class Part(InputPartition):
    """Folders to list alone, and folders to walk to the bottom."""

    def __init__(self, flat: list[str], deep: list[str], after: float = float("-inf"), upto: float = float("inf")):
        self.flat, self.deep, self.after, self.upto = flat, deep, after, upto


def dealt(roots: list[str], rules: Rules, enough: int = ENOUGH) -> list[tuple[list[str], list[str]]]:
    """Parts of trees: upper levels are opened until there are ``enough`` folders below."""
    flat: list[str] = []
    deep = [r for r in dict.fromkeys(roots) if not any(r != o and r.startswith(o + "/") for o in roots)]
    while deep and len(deep) < enough:
        flat += deep
        deep = [f for folder in deep for f in listed(folder, rules)[0]]
    flat = sorted(set(flat))
    step = max(1, -(-(len(flat) + len(deep)) // MOST_TASKS))
    parts = [([], deep[a : a + step]) for a in range(0, len(deep), step)]
    return parts + [(flat[a : a + 64 * step], []) for a in range(0, len(flat), 64 * step)]


def read(part: Part | None, rules: Rules) -> Iterator[tuple]:
    if part is None:
        return
    for folder in part.flat:
        yield from (f for f in listed(folder, rules)[1] if part.after < f[2] <= part.upto)
    for folder in part.deep:
        yield from (f for f in below(folder, rules) if part.after < f[2] <= part.upto)


def _options(options: dict) -> tuple[list[str], Rules]:
    roots = [r.rstrip("/") or "/" for r in json.loads(options["roots"])]
    return roots, Rules(json.loads(options.get("exclusions", "[]")), json.loads(options.get("extensions", "[]")))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots, self.rules = _options(options)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        rules = self.rules
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("path",) and (f.value.startswith(rules.prefix) or rules.prefix.startswith(f.value)):
                rules.prefix = max(rules.prefix, f.value, key=len)
            elif isinstance(f, EqualTo) and f.attribute == ("path",) and f.value.startswith(rules.prefix):
                rules.prefix = f.value
                yield f  # a prefix holds longer paths as well
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("size",):
                rules.least = max(rules.least, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("size",):
                most = f.value - isinstance(f, LessThan)
                rules.most = most if rules.most is None else min(rules.most, most)
            else:
                yield f

    def partitions(self) -> list[Part]:
        return [Part(*p) for p in dealt([r for r in self.roots if self.rules.descends(r)], self.rules)]

    def read(self, partition: Part | None) -> Iterator[tuple]:
        return read(partition, self.rules)


class FolderWalk(DataSource):
    """``format("folder_walk")``. Options: roots, exclusions, extensions (lists as JSON)."""

    @classmethod
    def name(cls) -> str:
        return "folder_walk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Watch(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.settle = options, float(options.get("settle", "2"))

    def _roots(self) -> list[str]:
        """The announced roots, read anew for each batch: a line each in the announcement file."""
        with open(self.options["announced"], encoding="utf-8") as f:
            return [line.rstrip("\n").rstrip("/") for line in f if line.strip()]

    def initialOffset(self) -> dict:
        return {"moment": 0.0, "roots": []}

    def latestOffset(self) -> dict:
        return {"moment": time.time() - self.settle, "roots": self._roots()}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        old = [r for r in end["roots"] if r in start["roots"]]
        new = [r for r in end["roots"] if r not in start["roots"]]
        rules = _options({**self.options, "roots": "[]"})[1]
        # what an old root holds was seen up to the start; a new root inside an old one holds nothing new
        new = [r for r in new if not any(r.startswith(o + "/") for o in old)]
        seen = [o for o in old if any(o.startswith(n + "/") for n in new)]
        parts = [Part(*p, after=start["moment"], upto=end["moment"]) for p in dealt(old, rules)]
        return parts + [Grown(*p, seen, end["moment"]) for p in dealt(new, rules)]

    def read(self, partition: Part | None) -> Iterator[tuple]:
        rules = _options({**self.options, "roots": "[]"})[1]
        if not isinstance(partition, Grown):
            return read(partition, rules)
        return (f for f in read(partition, rules) if not any(f[0].startswith(o + "/") for o in partition.seen))


class Grown(Part):
    """Part of a newly announced root, all of whose files count but those below roots announced before."""

    def __init__(self, flat: list[str], deep: list[str], seen: list[str], end: float):
        super().__init__(flat, deep, float("-inf"), end)
        self.seen = seen


class WatchedRoots(DataSource):
    """``format("watched_roots")``. Options: announced (a file with a root on each line), exclusions, extensions, settle."""

    @classmethod
    def name(cls) -> str:
        return "watched_roots"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Watch(dict(self.options))


def _option_lists(exclusions: Iterable[str], extensions: Iterable[str]) -> dict[str, str]:
    return {"exclusions": json.dumps(list(exclusions)), "extensions": json.dumps(list(extensions))}


def walked(spark: SparkSession, roots: list[str], exclusions: Iterable[str] = (), extensions: Iterable[str] = ()) -> DataFrame:
    """path, size, modified (seconds) of the files below ``roots``, each once."""
    spark.dataSource.register(FolderWalk)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("folder_walk").options(roots=json.dumps(roots), **_option_lists(exclusions, extensions)).load()


def watched(spark: SparkSession, announced: str, exclusions: Iterable[str] = (), extensions: Iterable[str] = (), settle: float = 2) -> DataFrame:
    """The same as a stream, for the roots that a file announces."""
    spark.dataSource.register(WatchedRoots)
    return spark.readStream.format("watched_roots").options(announced=announced, settle=str(settle), **_option_lists(exclusions, extensions)).load()

"""The tool's commands: a grammar as data, and a dispatcher over the engine's operators.

A line of the grammar is a command and its options; `*` marks a group of which one is needed, `/` stands between
the names of one group, and after each name come its values or its kind.
"""

from __future__ import annotations

import shlex
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.operators import blocks, dedupe, space, volumes
from blockloom.sources.store import Store

GRAMMAR = """
fs status        type=summary,verbose
fs inodeinfo     fsid=INT ino/path=INT/STRING
fs showdbns     *path/inode=STRING/INT
fs dumpinofile   fsid=INT
dedupe start     ignoreshared=true,false
drive clone     *backingdrivename/backingdrivefsid=STRING/INT
drive delete    *fsid/drivename=INT/STRING
drive mount     *fsid/drivename=INT/STRING
drive unmount   *fsid/drivename=INT/STRING
tool file        op=clone,move,rename,delete,newfolder source=STRING dest=STRING fsid=INT
"""


def grammar(text: str = GRAMMAR) -> dict[str, list[tuple[bool, dict[str, str]]]]:
    """For each command its groups of options: whether one of the group is needed, and name and kind of each."""
    out: dict[str, list[tuple[bool, dict[str, str]]]] = {}
    for line in text.strip().splitlines():
        main, sub, *groups = line.split()
        out[f"{main} {sub}"] = [
            (g.startswith("*"), dict(zip(g.lstrip("*").split("=")[0].split("/"), g.split("=")[1].split("/")))) for g in groups
        ]
    return out


def parse(line: str, rules: dict | None = None) -> tuple[str, dict[str, object]]:
    """The command and its options; a ValueError says what the grammar doesn't allow."""
    rules = rules or grammar()
    words = shlex.split(line)
    command, rest = " ".join(words[:2]), words[2:]
    if command not in rules:
        raise ValueError(f"no command {command!r}")
    kinds = {name: kind for _, group in rules[command] for name, kind in group.items()}
    options: dict[str, object] = {}
    for flag, value in zip(rest[::2], rest[1::2] + [""]):
        name = flag.lstrip("-")
        kind = kinds.get(name)
        if kind is None or not flag.startswith("-"):
            raise ValueError(f"{command} has no option {flag!r}")
        if kind == "INT":
            options[name] = int(value)
        elif kind == "STRING" or value in kind.split(","):
            options[name] = value
        else:
            raise ValueError(f"{flag} takes {kind}, not {value!r}")
    for needed, group in rules[command]:
        if sum(name in options for name in group) > 1 or (needed and not any(name in options for name in group)):
            raise ValueError(f"{command} takes one of {', '.join(group)}")
    return command, options


class Engine:
    """The store's tables under the commands. Tables: blockmap, inodes, volumes, and those of a dedupe run."""

    def __init__(self, store: Store, capacity: int = 1 << 30):
        self.store, self.capacity = store, capacity
        self.table: dict[str, Callable[..., DataFrame | int | bool]] = {
            "fs status": self.status, "fs inodeinfo": self.inodeinfo, "fs showdbns": self.showdbns, "fs dumpinofile": self.dumpinofile,
            "dedupe start": self.start, "drive clone": self.clone, "drive delete": self.delete, "drive mount": self.mount, "drive unmount": self.unmount,
            "tool file": self.file,
        }

    def __call__(self, line: str):
        command, options = parse(line)
        return self.table[command](**options)

    def status(self, type: str = "summary") -> DataFrame:
        every = self.store.read("blockmap")
        return space.summary(every, self.capacity) if type == "summary" else space.by_volume(every)

    def inodeinfo(self, fsid: int | None = None, ino: int | None = None, path: str | None = None) -> DataFrame:
        found = self.store.read("inodes")
        for name, value in (("fsid", fsid), ("ino", ino), ("path", path)):
            found = found if value is None else found.where(F.col(name) == value)
        return found

    def showdbns(self, inode: int | None = None, path: str | None = None) -> DataFrame:
        every = self.store.read("blockmap")
        if inode is not None:
            return every.where(F.col("ino") == inode).select("fsid", "ino", "fbn", "dbn").orderBy("fsid", "ino", "fbn")
        own = self.store.read("inodes").where(F.col("path") == path).select("fsid", "ino")
        return every.join(own, ["fsid", "ino"], "left_semi").select("fsid", "ino", "fbn", "dbn").orderBy("fsid", "ino", "fbn")

    def dumpinofile(self, fsid: int | None = None) -> DataFrame:
        return self.inodeinfo(fsid)

    def start(self, ignoreshared: str = "false") -> int:
        return dedupe.run(self.store, ignoreshared == "true")

    def _fsid(self, fsid: int | None, name: str | None) -> int:
        own = self.store.read("volumes").where(F.col("fsid") == fsid if fsid is not None else F.col("name") == name).select("fsid").limit(2).collect()
        if len(own) != 1:
            raise ValueError(f"{len(own) or 'no'} volumes {fsid if fsid is not None else name!r}")
        return own[0].fsid

    def clone(self, backingdrivename: str | None = None, backingdrivefsid: int | None = None) -> int:
        """The new volume's number."""
        every, of = self.store.read("volumes"), self._fsid(backingdrivefsid, backingdrivename)
        new = every.agg(F.max("fsid")).first()[0] + 1
        seq = self.store.versions()[-1]
        self.store.publish(volumes=volumes.snapshot(every, of, new, f"clone-{new}", seq))
        return new

    def delete(self, fsid: int | None = None, drivename: str | None = None) -> bool:
        """Whether it went: a volume that others stand on stays."""
        every, own = self.store.read("volumes"), self._fsid(fsid, drivename)
        left = volumes.delete(every, every.where(F.col("fsid") == own))
        if left.where(F.col("fsid") == own).limit(1).count():
            return False
        self.store.publish(volumes=left)
        return True

    def mount(self, fsid: int | None = None, drivename: str | None = None) -> str:
        """The name of the view."""
        own = self._fsid(fsid, drivename)
        volumes.open_volume(self.store.read("blockmap"), self.store.read("volumes"), own, f"volume_{own}")
        return f"volume_{own}"

    def unmount(self, fsid: int | None = None, drivename: str | None = None) -> bool:
        return volumes.close_volume(self.store.read("volumes"), f"volume_{self._fsid(fsid, drivename)}")

    def file(self, op: str = "clone", source: str = "", dest: str = "", fsid: int = 0) -> int:
        """Files and folders by path; returns the version that holds the result."""
        inodes = self.store.read("inodes")
        if op == "newfolder":
            old = self.store.read("folders") if "folders" in self.names() else inodes.select("path").limit(0)
            return self.store.publish(folders=volumes.new_folder(old, dest))
        if op == "clone":
            new = volumes.clone_directory(inodes, source, fsid, dest).join(inodes.select(F.col("fsid").alias("src_fsid"), F.col("ino").alias("src_ino"), "size", "nblocks"), ["src_fsid", "src_ino"])
            made = inodes.unionByName(new.select(*inodes.columns))
        else:
            made = {"move": lambda: volumes.move(inodes, source, dest), "rename": lambda: volumes.rename(inodes, source, dest), "delete": lambda: volumes.remove(inodes, source)}[op]()
        return self.store.publish(inodes=made)

    def names(self) -> set[str]:
        every = self.store.published()
        return set() if every is None else {r.name for r in every.select("name").distinct().collect()}


def loaded(store: Store, files: DataFrame, every_volume: DataFrame) -> Engine:
    """An engine over files (fsid, ino, text) and volumes."""
    cut = blocks.blocks(files)
    store.publish(blockmap=cut, inodes=blocks.inodes(files), volumes=every_volume)
    return Engine(store)

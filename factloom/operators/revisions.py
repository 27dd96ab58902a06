"""Safe edits of notes: preview with a token, snapshot, write, restore; and the same rules as columns."""

from __future__ import annotations

import hashlib
import os
import time
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEPT_SNAPSHOTS = 20
CONTEXT_LINES = 3


def match_count(content: Column, old: Column) -> Column:
    """How often `old` stands in the content, not overlapping."""
    return ((F.length(content) - F.length(F.replace(content, old, F.lit("")))) / F.length(old)).cast("int")


def replace_unique(content: Column, old: Column, new: Column) -> Column:
    """The content with its only `old` replaced; null if there is none, more than one, or no change."""
    at = F.position(old, content)
    edited = F.concat(content.substr(F.lit(1), at - 1), new, content.substr(at + F.length(old), F.length(content)))
    return F.when((match_count(content, old) == 1) & (old != new), edited)


def confirm_token(path: Column, current: Column, following: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", path, current, following), 256), 1, 16)


def retained(revisions: DataFrame, keep: int = KEPT_SNAPSHOTS) -> DataFrame:
    """The newest revisions (path, ts_ms, ...) of each note."""
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("ts_ms")))
    return revisions.withColumn("__rank", rank).where(F.col("__rank") <= keep).drop("__rank")


def line_diff(old: str, new: str, context: int = CONTEXT_LINES) -> str:
    """One hunk around the changed lines; its header names the change, not the context."""
    a, b = old.split("\n"), new.split("\n")
    head = len(os.path.commonprefix([a, b]))
    tail = len(os.path.commonprefix([a[head:][::-1], b[head:][::-1]]))
    gone, come = a[head : len(a) - tail], b[head : len(b) - tail]
    before, after = a[max(0, head - context) : head], a[len(a) - tail :][:context]
    rows = [f"@@ -{head + 1},{len(gone)} +{head + 1},{len(come)} @@"]
    for sign, part in ((" ", before), ("-", gone), ("+", come), (" ", after)):
        rows += [sign + x for x in part]
    return "\n".join(rows)


class EditError(ValueError):
    """An edit that cannot be made."""


@dataclass(frozen=True)
class Preview:
    path: str
    diff: str
    token: str


@dataclass(frozen=True)
class Applied:
    path: str
    snapshot: str
    reindexed_chunks: int


@dataclass(frozen=True)
class Restored:
    path: str
    restored_from: str
    pre_restore_snapshot: str
    reindexed_chunks: int


class NoteEditor:
    """Edits below one vault folder; snapshots lie in a folder of their own. reindex(path) returns the number of chunks."""

    def __init__(self, root: str, snapshots: str, reindex=lambda path: 0):
        self.root, self.snapshots, self.reindex = Path(os.path.abspath(root)), Path(os.path.abspath(snapshots)), reindex

    def _resolve(self, path: str) -> Path:
        full = Path(os.path.abspath(self.root / path))
        if not full.is_relative_to(self.root):
            raise EditError(f"{path} is outside the vault")
        if full.suffix.lower() != ".md":
            raise EditError(f"{path} is not a Markdown note")
        return full

    def edit(self, path: str, old: str, new: str, confirm: str | None = None) -> Preview | Applied:
        """Without a token a preview; with the right one the edit, behind a snapshot."""
        full = self._resolve(path)
        current = full.read_text(encoding="utf-8")
        n = current.count(old) if old else 0
        if n != 1:
            raise EditError(f"the text was not found in {path}" if n == 0 else f"the text stands {n} times in {path}")
        following = current.replace(old, new)
        if following == current:
            raise EditError("the edit changes nothing")
        token = hashlib.sha256(f"{path}\n{current}\n{following}".encode()).hexdigest()[:16]
        if confirm is None:
            return Preview(path, line_diff(current, following), token)
        if confirm != token:
            raise EditError("the token does not fit the note as it is now")
        snapshot = self._snapshot(path, current)
        full.write_text(following, encoding="utf-8")
        return Applied(path, snapshot, self.reindex(path))

    def restore(self, path: str, snapshot: str) -> Restored:
        full, source = self._resolve(path), Path(os.path.abspath(snapshot))
        if not source.is_relative_to(self.snapshots):
            raise EditError("the snapshot is outside the snapshot folder")
        earlier = source.read_text(encoding="utf-8")
        before = self._snapshot(path, full.read_text(encoding="utf-8") if full.exists() else "")
        full.write_text(earlier, encoding="utf-8")
        return Restored(path, str(source), before, self.reindex(path))

    def _snapshot(self, path: str, content: str) -> str:
        """One folder a note, so that notes with like names cannot be taken for each other."""
        folder = self.snapshots / path.replace("/", "__").replace("\\", "__")
        folder.mkdir(parents=True, exist_ok=True)
        stamp = int(time.time() * 1000)
        while (folder / f"{stamp}.bak").exists():
            stamp += 1
        (folder / f"{stamp}.bak").write_text(content, encoding="utf-8")
        for old in self.listing(path)[KEPT_SNAPSHOTS:]:
            os.remove(old)
        return str(folder / f"{stamp}.bak")

    def listing(self, path: str) -> list[str]:
        """The snapshots of a note, newest first."""
        folder = self.snapshots / path.replace("/", "__").replace("\\", "__")
        return [str(p) for p in sorted(folder.glob("*.bak"), key=lambda p: -int(p.stem))]

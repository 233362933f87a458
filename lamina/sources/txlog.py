"""The transaction log of a store: one JSON file per version, created only if it is not there yet.

The state at a version is the fold of all commits up to it. A commit may hold records inline (small
batches, not yet in a segment), files added and removed, new column families, pinned snapshots and
counters. Every so often the state is written beside the commits, and a fold starts from there; batches
not flushed are named in it by their commits, so that a full buffer is not written again each time.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from ..errors import CorruptError

#: cf_id, vt, key, value, end_key
Op = tuple[int, int, bytes, bytes | None, bytes | None]
COUNTERS = ("puts", "deletes", "write_batches", "stall_waits", "flushes", "compactions", "trivial_moves", "background_errors", "checkpoints")


def _text(b: bytes | None) -> str | None:
    return None if b is None else base64.b64encode(b).decode()


def _bytes(t: str | None) -> bytes | None:
    return None if t is None else base64.b64decode(t)


def pack_ops(ops: list[Op]) -> list[list]:
    return [[cf, vt, _text(k), _text(v), _text(e)] for cf, vt, k, v, e in ops]


def unpack_ops(rows: list[list]) -> list[Op]:
    return [(cf, vt, _bytes(k), _bytes(v), _bytes(e)) for cf, vt, k, v, e in rows]


def buffered_bytes(ops: list[Op]) -> int:
    """What a batch counts for in the buffer."""
    return sum(len(k) + 9 + len(v or b"") for _, _, k, v, _ in ops)


def _meta_out(meta: dict) -> dict:
    return {k: _text(v) if isinstance(v, bytes) else v for k, v in meta.items()}


def _meta_in(meta: dict) -> dict:
    return meta | {"min_key": _bytes(meta["min_key"]), "max_key": _bytes(meta["max_key"])}


@dataclass
class State:
    version: int = -1
    last_seq: int = 0
    next_file_id: int = 1
    files: dict[str, dict] = field(default_factory=dict)
    families: dict[int, str] = field(default_factory=lambda: {0: "default"})
    pinned: list[int] = field(default_factory=list)
    inline: list[tuple[int, list[Op]]] = field(default_factory=list)
    counters: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTERS, 0))
    applied: dict[str, int] = field(default_factory=dict)
    #: Snapshots below this may have lost versions, unless pinned.
    compacted_through: int = 0
    #: The bytes of all inline batches, and the commit that holds each, by its first sequence number.
    inline_bytes: int = 0
    inline_at: dict[int, int] = field(default_factory=dict)

    def copied(self) -> State:
        """A state that can be changed alone; batches and file statistics are never changed in place."""
        own = {k: getattr(self, k).copy() for k in ("files", "families", "pinned", "inline", "counters", "applied", "inline_at")}
        return replace(self, **own)

    def apply(self, version: int, entry: dict) -> None:
        self.version = version
        if "ops" in entry:
            ops = unpack_ops(entry["ops"])
            self.inline.append((entry["start_seq"], ops))
            self.inline_bytes += buffered_bytes(ops)
            self.inline_at[entry["start_seq"]] = version
        self.last_seq = max(self.last_seq, entry.get("last_seq", 0))
        for path in entry.get("remove", ()):
            self.files.pop(path, None)
        for meta in map(_meta_in, entry.get("add", ())):
            self.files[meta["path"]] = meta
            self.next_file_id = max(self.next_file_id, meta["file_id"] + 1)
        if "flushed_through" in entry:
            self.inline = [(s, ops) for s, ops in self.inline if s + len(ops) - 1 > entry["flushed_through"]]
            self.inline_bytes = sum(buffered_bytes(ops) for _, ops in self.inline)
            self.inline_at = {s: self.inline_at[s] for s, _ in self.inline if s in self.inline_at}
        for cf, name in entry.get("families", ()):
            self.families[cf] = name
        self.pinned = entry.get("pinned", self.pinned)
        self.compacted_through = max(self.compacted_through, entry.get("compacted_through", 0))
        for name, n in entry.get("counters", {}).items():
            self.counters[name] = self.counters.get(name, 0) + n
        self.applied |= entry.get("applied", {})

    def to_json(self, by_commit: bool = False) -> dict:
        """The whole state; by_commit names the commits of batches instead of repeating them."""
        at = self.inline_at if by_commit else {}
        out = {k: getattr(self, k) for k in ("version", "last_seq", "next_file_id", "pinned", "counters", "applied", "compacted_through")}
        return out | {
            "files": [_meta_out(m) for m in self.files.values()],
            "families": sorted(self.families.items()),
            "inline": [[s, pack_ops(ops)] for s, ops in self.inline if s not in at],
            "inline_at": sorted(at.items()),
        }

    @staticmethod
    def from_json(data: dict, commit: Callable[[int], dict] | None = None) -> State:
        """commit reads a commit by its version; without it, batches that are only named are left out."""
        out = State(**{k: data[k] for k in ("version", "last_seq", "next_file_id", "pinned", "counters", "applied", "compacted_through")})
        out.files = {m["path"]: m for m in map(_meta_in, data["files"])}
        out.families = {int(k): v for k, v in data["families"]}
        out.inline = [(s, unpack_ops(ops)) for s, ops in data["inline"]]
        if commit:
            out.inline_at = dict(data.get("inline_at", ()))
            out.inline += [(s, unpack_ops(commit(version)["ops"])) for s, version in out.inline_at.items()]
            out.inline.sort(key=lambda x: x[0])
        out.inline_bytes = sum(buffered_bytes(ops) for _, ops in out.inline)
        return out


class TxLog:
    """fault(step) is called before and after each commit; a test may raise there."""

    def __init__(self, files, checkpoint_every: int = 64, fault: Callable[[str], None] = lambda step: None):
        self._files, self._every, self.fault = files, checkpoint_every, fault
        files.make("_log")

    @staticmethod
    def _name(version: int, kind: str = "commit") -> str:
        return f"_log/{version:020d}.{kind}.json"

    def _read(self, name: str) -> dict:
        try:
            return json.loads(self._files.read(name))
        except ValueError as e:
            raise CorruptError(f"{name} is not whole") from e

    def state(self, known: State | None = None) -> State:
        """The newest state. From a known one, only the commits that follow it are looked for."""
        if known is not None:
            state = known.copied()
            while self._files.exists(self._name(state.version + 1)):
                state.apply(state.version + 1, self._read(self._name(state.version + 1)))
            return state
        names = [n for n in self._files.list("_log") if n.endswith(".json") and not n.startswith(".")]
        commits = sorted(int(n[:20]) for n in names if n.endswith(".commit.json"))
        points = [int(n[:20]) for n in names if n.endswith(".state.json")]
        state = State.from_json(self._read(self._name(max(points), "state")), lambda version: self._read(self._name(version))) if points else State()
        for version in commits:
            if version > state.version:
                if version != state.version + 1:
                    raise CorruptError(f"commit {state.version + 1} is missing")
                state.apply(version, self._read(self._name(version)))
        return state

    def commit(self, state: State, entry: dict) -> State | None:
        """The state after the entry as the next version, or None if another writer was first."""
        version = state.version + 1
        if "add" in entry:
            entry = entry | {"add": [_meta_out(m) for m in entry["add"]]}
        self.fault("commit:before")
        if not self._files.write_new(self._name(version), json.dumps(entry).encode()):
            return None
        self.fault("commit:after")
        after = state.copied()
        after.apply(version, entry)
        if self._every and version and version % self._every == 0:
            after.counters["checkpoints"] += 1
            self._files.write_new(self._name(version, "state"), json.dumps(after.to_json(by_commit=True)).encode())
        return after

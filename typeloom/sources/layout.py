"""Canonical folder and file names for raw logs: a driver-side utility over a local folder, a dry run unless told otherwise."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from pathlib import Path

from typeloom.sources.typing_logs import FOLDERS, SCENARIOS

#: Fixed value: names of log files as they are found, with the copy number that browsers add.
LOG_NAME = re.compile(r"s([1-5])_(keystrokes|responses|user_info)(?: \(\d+\))?\.json")
MANIFEST = "normalization_manifest.json"


@dataclass(frozen=True)
class Move:
    source: Path
    target: Path

    def record(self, root: Path) -> dict:
        digest = hashlib.sha256(self.source.read_bytes()).hexdigest()
        return {"source": str(self.source.relative_to(root)), "target": str(self.target.relative_to(root)), "sha256": digest}


def target_of(file: Path, user: Path) -> Path:
    """Where a file of a scenario folder belongs; a name that isn't a log's stays."""
    session, log = FOLDERS[file.parent.name], LOG_NAME.fullmatch(file.name)
    if log and int(log[1]) != session:
        raise ValueError(f"{file} lies in the folder of session {session}")
    return user / SCENARIOS[session] / (f"s{session}_{log[2]}.json" if log else file.name)


def plan(root: Path) -> list[Move]:
    """The moves that are needed; an error before any of them if two files want one place."""
    root = Path(root).resolve(strict=True)
    found = [(f, u) for u in sorted(root.iterdir()) if u.is_dir() for d in sorted(u.iterdir()) if d.is_dir() and d.name in FOLDERS for f in sorted(d.iterdir())]
    moves, claimed = [], {}
    for file, user in found:
        if not file.is_file() or not file.resolve().is_relative_to(root):
            raise ValueError(f"{file} isn't a file of this dataset")
        target = target_of(file, user)
        if target in claimed or (target != file and target.exists()):
            raise ValueError(f"{file} and {claimed.get(target, target)} want the same place")
        claimed[target] = file
        if target != file:
            moves.append(Move(file, target))
    return moves


def normalize(root: Path, apply: bool = False) -> list[Move]:
    """The moves, made if ``apply`` says so; their manifest is written first, and never over another one."""
    root = Path(root).resolve(strict=True)
    moves = plan(root)
    if apply and moves:
        with (root.parent / MANIFEST).open("x", encoding="utf-8") as out:
            json.dump({"root": str(root), "moves": [m.record(root) for m in moves]}, out, indent=2)
        for move in moves:
            move.target.parent.mkdir(parents=True, exist_ok=True)
            move.source.rename(move.target)
        for folder in {m.source.parent for m in moves}:
            if not any(folder.iterdir()):
                folder.rmdir()
    return moves

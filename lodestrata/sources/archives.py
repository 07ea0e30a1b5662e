"""Guarded reading and registration of reference archives (driver side; archives are single files)."""

from __future__ import annotations

import hashlib
import zipfile
from datetime import date
from pathlib import Path, PurePosixPath

from lodestrata.sources.files import SourceError

#: Bounds of an archive: members, bytes unpacked, and how far it may expand.
MOST_MEMBERS, MOST_BYTES, MOST_RATIO = 10_000, 4 << 30, 200


def sha256_file(path: str | Path) -> str:
    with Path(path).open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def safe_members(archive: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    """The archive's files, after checks of number, size, expansion, names and links."""
    files = [m for m in archive.infolist() if not m.is_dir()]
    if len(files) > MOST_MEMBERS or sum(m.file_size for m in files) > MOST_BYTES:
        raise SourceError("the archive is too large")
    seen = set()
    for m in files:
        path = PurePosixPath(m.filename.replace("\\", "/"))
        if path.is_absolute() or ".." in path.parts or ":" in m.filename or not path.parts:
            raise SourceError(f"unsafe name {m.filename!r}")
        if m.file_size > MOST_RATIO * max(m.compress_size, 1) and m.file_size > 1 << 20:
            raise SourceError(f"{m.filename!r} expands too far")
        if (m.external_attr >> 16) & 0o170000 == 0o120000:
            raise SourceError(f"{m.filename!r} is a link")
        if str(path).lower() in seen:
            raise SourceError(f"{m.filename!r} stands twice")
        seen.add(str(path).lower())
    return files


def acquired(day: str, today: date | None = None) -> date:
    """The day of acquisition, which can't be in the future."""
    found = date.fromisoformat(day)
    if found > (today or date.today()):
        raise SourceError(f"{day} is in the future")
    return found


def unpack(path: str | Path, folder: str | Path) -> list[tuple[str, int, str]]:
    """``(name, bytes, sha256)`` of all members, written below ``folder``. All are checked first; a file that is there with other content is an error, and nothing is written."""
    folder = Path(folder)
    with zipfile.ZipFile(path) as z:
        members = [(m, folder / PurePosixPath(m.filename.replace("\\", "/"))) for m in safe_members(z)]
        rows, write = [], []
        for m, to in members:
            with z.open(m) as f:
                digest = hashlib.file_digest(f, "sha256").hexdigest()
            if to.exists() and sha256_file(to) != digest:
                raise SourceError(f"{to} is there with other content")
            rows.append((m.filename, m.file_size, digest))
            if not to.exists():
                write.append((m, to))
        for m, to in write:
            to.parent.mkdir(parents=True, exist_ok=True)
            with z.open(m) as f, to.open("xb") as out:
                while piece := f.read(1 << 20):
                    out.write(piece)
    return rows


def only_folder(parent: str | Path, prefix: str) -> Path:
    """The one folder whose name starts with the prefix."""
    found = [p for p in Path(parent).iterdir() if p.is_dir() and p.name.startswith(prefix)]
    if len(found) != 1:
        raise SourceError(f"{len(found)} folders start with {prefix!r}")
    return found[0]


def required_files(folder: str | Path, names: list[str]) -> dict[str, Path]:
    missing = [n for n in names if not (Path(folder) / n).is_file()]
    if missing:
        raise SourceError(f"missing: {', '.join(missing)}")
    return {n: Path(folder) / n for n in names}

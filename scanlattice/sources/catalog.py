"""Finding a scan's counted file by its numbers."""

from __future__ import annotations

import re
from pathlib import Path

#: (ending, file type) by kind; fixed values of the data portal.
SUFFIXES = {"standard": ("", "h5"), "offsets": ("_offsets", "emd"), "centered": ("_centered", "h5")}
_V1 = re.compile(r"FOURD_[^_]*_[^_]*_(?P<scan_id>\d+)_(?P<scan_num>\d+)(?P<ending>_[a-z]+)?")
_V0 = re.compile(r"data_scan(?P<scan_num>\d+)(?:_id(?P<scan_id>\d+))?(?:_th(?P<th>\d+))?.*?_electrons(?P<ending>_[a-z]+)?")


def find_scan(directory: str, scan_num: int | None = None, scan_id: int | None = None, th: int | None = None, suffix: str = "standard", version: int | None = None) -> tuple[Path, dict]:
    """(path, numbers) of the one file that fits; the newer naming scheme is tried first.

    Several fits raise ValueError, none FileNotFoundError, no number to look for TypeError.
    """
    if scan_num is None and scan_id is None:
        raise TypeError("pass scan_num or scan_id")
    ending, kind = SUFFIXES[suffix]
    wanted = {"scan_num": scan_num, "scan_id": scan_id, "th": th}
    for v in (1, 0) if version is None else (version,):
        found = []
        for path in sorted(Path(directory).glob(f"*.{kind}")):
            m = (_V1 if v == 1 else _V0).fullmatch(path.stem)
            if not m or (m["ending"] or "") != ending:
                continue
            own = {k: int(x) for k, x in m.groupdict().items() if k != "ending" and x}
            if all(own.get(k) == x for k, x in wanted.items() if x is not None):
                found.append((path, own))
        if len(found) > 1:
            raise ValueError(f"several files fit: {[str(p) for p, _ in found]}")
        if found:
            return found[0]
    raise FileNotFoundError(f"no file in {directory} fits")

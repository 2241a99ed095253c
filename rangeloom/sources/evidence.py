"""A folder of a campaign's records as one ZIP that is the same whenever it is made. Records are small; this is the driver's."""

from __future__ import annotations

import hashlib
import os
import zipfile

FIRST_DATE = (1980, 1, 1, 0, 0, 0)


def pack(folder: str, path: str) -> dict:
    """Write all files below ``folder`` in order of their names, with one date and one mode. Returns inspect()."""
    own = os.path.abspath(path)
    names = sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, files in os.walk(folder) for f in files if os.path.abspath(os.path.join(d, f)) != own)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as z:
        for n in names:
            about = zipfile.ZipInfo(n.replace(os.sep, "/"), FIRST_DATE)
            about.create_system, about.external_attr, about.compress_type = 3, 0o100644 << 16, zipfile.ZIP_DEFLATED
            with open(os.path.join(folder, n), "rb") as f:
                z.writestr(about, f.read())
    return inspect(path, names)


def inspect(path: str, wanted: list[str] = []) -> dict:  # noqa: B006
    """Members, digest, and whether every member can be read and none that is wanted is missing."""
    with zipfile.ZipFile(path) as z:
        names, bad = sorted(z.namelist()), z.testzip()
    missing = sorted(set(wanted) - set(names))
    with open(path, "rb") as f:
        digest = hashlib.file_digest(f, "sha256").hexdigest()
    return {"members": names, "sha256": digest, "bytes": os.path.getsize(path), "missing": missing, "readable": bad is None and not missing}

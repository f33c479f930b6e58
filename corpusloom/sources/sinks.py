"""Writers: JSON lines from Spark, and small artifacts staged and swapped on the driver."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(rows: DataFrame, key: str, value: list[str], order: list[str]) -> DataFrame:
    """``value``: one object a row, ``{key, prediction}``, in input order. Ready for ``write.text``."""
    return rows.orderBy(*order).select(F.to_json(F.struct(F.col(key), F.struct(*value).alias("prediction"))).alias("value"))


def canonical_json(value: object) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False) + "\n"


def rounded(value: object, scale: float = 1e9) -> object:
    """All floats of a tree rounded half away from zero to 1/scale, keys sorted."""
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, float):
        y = abs(value) * scale
        return (1 if value >= 0 else -1) * float(int(y + 0.5)) / scale
    if isinstance(value, Mapping):
        return {k: rounded(value[k], scale) for k in sorted(value)}
    return [rounded(x, scale) for x in value]


def same_json(a: object, b: object, within: float = 2e-9) -> bool:
    """Equal trees, but that numbers may differ a little."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return abs(a - b) <= within
    if isinstance(a, Mapping) and isinstance(b, Mapping):
        return a.keys() == b.keys() and all(same_json(a[k], b[k], within) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(same_json(x, y, within) for x, y in zip(a, b))
    return a == b


def distinct_paths(paths: list[str]) -> None:
    """Raises if two paths name the same file, by links or by missing parts."""
    seen: dict[str, str] = {}
    for p in paths:
        real = os.path.realpath(p)
        if real in seen:
            raise ValueError(f"{p} and {seen[real]} are the same file")
        seen[real] = p


def write_all(contents: Mapping[str, str], fail_after: int | None = None) -> None:
    """Writes all files or none: staged beside their places, originals moved aside, restored on any failure.

    ``fail_after`` makes the installation fail after so many files, for tests.
    """
    distinct_paths(list(contents))
    staged, aside, placed = {}, {}, []
    try:
        for path, text in contents.items():
            os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
            fd, name = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".staged-")
            with os.fdopen(fd, "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            staged[path] = name
        for i, (path, name) in enumerate(staged.items()):
            if fail_after is not None and i >= fail_after:
                raise OSError("installation was made to fail")
            if os.path.exists(path):
                aside[path] = f"{name}.original"
                os.replace(path, aside[path])
            os.replace(name, path)
            placed.append(path)
    except BaseException:
        for path in placed:
            if path not in aside:
                os.unlink(path)
        for path, name in aside.items():
            os.replace(name, path)
        raise
    finally:
        for name in staged.values():
            if os.path.exists(name):
                os.unlink(name)
    for name in aside.values():
        os.unlink(name)


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def replace_folder(path: str, files: Mapping[str, str], verify) -> None:
    """Writes a folder of files and swaps it in, verified before and after; the old folder comes back on failure.

    A folder that isn't empty and that ``verify`` doesn't accept is never replaced.
    """
    parent = os.path.dirname(os.path.abspath(path))
    os.makedirs(parent, exist_ok=True)
    if os.path.isdir(path) and os.listdir(path):
        verify(path)
    stage = tempfile.mkdtemp(dir=parent, prefix=".staged-")
    old = None
    try:
        for name, text in files.items():
            with open(os.path.join(stage, name), "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
        verify(stage)
        if os.path.isdir(path):
            old = tempfile.mkdtemp(dir=parent, prefix=".old-")
            os.rmdir(old)
            os.rename(path, old)
        os.rename(stage, path)
        try:
            verify(path)
        except BaseException:
            shutil.rmtree(path)
            if old:
                os.rename(old, path)
                old = None
            raise
    except BaseException:
        if old and not os.path.exists(path):
            os.rename(old, path)
            old = None
        raise
    finally:
        shutil.rmtree(stage, ignore_errors=True)
        if old:
            shutil.rmtree(old, ignore_errors=True)

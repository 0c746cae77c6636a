"""Sinks: evidence tables as CSV, JSON lines, the answer package."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def padded(grid: Column) -> Column:
    """A grid with all rows as long as the longest."""
    widest = F.array_max(F.transform(grid, F.size))
    return F.transform(grid, lambda r: F.concat(r, F.array_repeat(F.lit(""), widest - F.size(r))))


def csv_text(grid: Column, header: bool = False) -> Column:
    """A grid as CSV. Cells are quoted where they must be; with ``header`` all are, below names col_0, col_1 and so on."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    cell = (lambda c: quoted(c)) if header else (lambda c: F.when(c.rlike(r'[",\r\n]'), quoted(c)).otherwise(c))
    lines = F.transform(padded(grid), lambda r: F.array_join(F.transform(r, cell), ","))
    if header:
        names = F.array_join(F.transform(F.element_at(padded(grid), 1), lambda c, i: F.concat(F.lit('"col_'), i, F.lit('"'))), ",")
        lines = F.concat(F.array(names), lines)
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_package(answers: DataFrame, evidence: DataFrame, path: str) -> None:
    """One zip with submission.json and data/tables/*.csv.

    The format is one file, so one process writes it; rows come partition by partition and go straight into it, so that
    memory holds a partition and not the package.
    """
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as z:
        with z.open("submission.json", "w", force_zip64=True) as out:
            out.write(b"[")
            for i, r in enumerate(answers.toLocalIterator()):
                out.write((", " if i else "").encode() + json.dumps(r.asDict(recursive=True), ensure_ascii=False).encode())
            out.write(b"]")
        for r in evidence.toLocalIterator():
            z.writestr(f"data/tables/{r['name']}.csv", r["csv"])


def safe_unzip(path: str, to: str) -> list[str]:
    """Extract a zip, but refuse members with absolute or upward paths."""
    with zipfile.ZipFile(path) as z:
        for name in z.namelist():
            p = PurePosixPath(name)
            if p.is_absolute() or ".." in p.parts:
                raise ValueError(f"unsafe member {name}")
        if z.testzip():
            raise ValueError("damaged archive")
        z.extractall(Path(to))
        return z.namelist()


def import_vectors(vectors: str, ids: str, to: str, rows: int = 50_000) -> None:
    """Turn a matrix file (npy, mapped) and its JSON list of keys into Parquet with key, vector_row and vector, piece by piece."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    matrix, keys = np.load(vectors, mmap_mode="r"), json.loads(Path(ids).read_text(encoding="utf-8"))
    if len(matrix) != len(keys):
        raise ValueError("keys and vectors differ in number")
    Path(to).mkdir(parents=True, exist_ok=True)
    for n, a in enumerate(range(0, len(keys), rows)):
        part = np.asarray(matrix[a : a + rows], dtype=np.float32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(part.reshape(-1)))
        key = pa.array(["|".join(map(str, k)) if isinstance(k, list) else str(k) for k in keys[a : a + rows]])
        pq.write_table(pa.table({"key": key, "vector_row": pa.array(np.arange(a, a + len(part))), "vector": lists}), f"{to}/part-{n:05d}.parquet")


def read_package(path: str, expected: int | None = None) -> tuple[list[dict], list[str]]:
    """Answers and table members of a package; refuses damaged ones, repeated ids and another count than expected."""
    with zipfile.ZipFile(path) as z:
        if z.testzip():
            raise ValueError("damaged archive")
        answers = json.loads(z.read("submission.json"))
        if len({a["id"] for a in answers}) != len(answers) or (expected is not None and len(answers) != expected):
            raise ValueError("ids are repeated or not as many as expected")
        return answers, [n for n in z.namelist() if n.startswith("data/tables/")]

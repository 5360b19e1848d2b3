"""Writers: guarded and atomic tables, audit logs, manifests, archives, LaTeX."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import shutil
import tarfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame

from corpusmill.functions.text import latex
from corpusmill.operators.records import fingerprint


def guarded(df: DataFrame, path: str, overwrite: bool = False, partition_by: list[str] | None = None, columns: list[str] | None = None, format: str = "parquet", **options: str) -> str:
    """Writes a table, refusing an existing output unless told to overwrite; optionally fewer columns, a folder per value, or another format with its options."""
    w = (df.select(*columns) if columns else df).write.mode("overwrite" if overwrite else "errorifexists").format(format).options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)
    return path


def atomic(df: DataFrame, path: str) -> str:
    """Writes beside the output and puts it in place by renaming, so that a reader sees the old table or the new one.

    For tables that are computed from the output itself. On stores without a rename, write to a new path instead.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    new, old = f"{path}.{uuid.uuid4().hex}.part", f"{path}.{uuid.uuid4().hex}.old"
    df.write.parquet(new)
    p = jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(p(path))
    if had and not fs.rename(p(path), p(old)):
        raise OSError(f"{path} can't be moved away")
    if not fs.rename(p(new), p(path)):
        raise OSError(f"{new} can't be put in place")
    if had:
        fs.delete(p(old), True)
    return path


def audit_log(df: DataFrame, path: str) -> None:
    """Appends JSON lines with sorted keys."""
    df.select(*sorted(df.columns)).write.mode("append").json(path)


def sha256(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def write_manifest(path: str, inputs: list[str], outputs: dict[str, DataFrame], settings: dict) -> dict:
    """Hashes of input files, fingerprints of tables, settings and versions, as JSON."""
    from pyspark import __version__ as spark_version

    tables = {}
    for name, df in outputs.items():
        f = fingerprint(df, df.columns).first()
        tables[name] = {"rows": f.n_rows, "fingerprint": f.fingerprint, "columns": df.columns}
    made = {"inputs": {p: {"size": os.path.getsize(p), "sha256": sha256(p)} for p in inputs}, "tables": tables, "settings": settings, "python": platform.python_version(), "spark": spark_version}
    part = Path(f"{path}.part")
    part.write_text(json.dumps(made, indent=2, sort_keys=True))
    part.replace(path)
    return made


def verify_manifest(path: str, tables: dict[str, DataFrame]) -> list[str]:
    """What differs from a manifest: changed or missing files and tables. An empty list is good."""
    made, wrong = json.loads(Path(path).read_text()), []
    for p, r in made["inputs"].items():
        if not os.path.exists(p):
            wrong.append(f"{p} is missing")
        elif sha256(p) != r["sha256"]:
            wrong.append(f"{p} has changed")
    for n, r in made["tables"].items():
        if n not in tables:
            wrong.append(f"table {n} is missing")
            continue
        f = fingerprint(tables[n], r["columns"]).first()
        if (f.n_rows, f.fingerprint) != (r["rows"], r["fingerprint"]):
            wrong.append(f"table {n} has changed")
    return wrong


def same_run(path: str, settings: dict, overwrite: bool = False) -> None:
    """Settles what a run at a path is of: the first run writes its settings there, later ones must have the same or say that they overwrite."""
    p = Path(path)
    if p.exists() and not overwrite:
        if json.loads(p.read_text()) != json.loads(json.dumps(settings)):
            raise ValueError(f"{path} is of a run with other settings; take another path, or overwrite it")
        return
    p.parent.mkdir(parents=True, exist_ok=True)
    part = Path(f"{path}.part")
    part.write_text(json.dumps(settings, indent=2, sort_keys=True))
    part.replace(p)


def verify_chain(paths: list[str]) -> list[str]:
    """Manifests in order: each must have the one before it, unchanged, among its inputs."""
    wrong = []
    for a, b in zip(paths, paths[1:]):
        seen = json.loads(Path(b).read_text())["inputs"].get(a)
        if seen is None:
            wrong.append(f"{b} doesn't build on {a}")
        elif seen["sha256"] != sha256(a):
            wrong.append(f"{a} has changed since {b}")
    return wrong


def archive(files: list[str], folder: str, version: str) -> str:
    """Files in a new version of an archive with their hashes; an existing version is refused."""
    target = Path(folder, version)
    target.mkdir(parents=True)
    listed = {}
    for f in files:
        shutil.copy2(f, target / Path(f).name)
        listed[Path(f).name] = sha256(f)
    (target / "hashes.json").write_text(json.dumps(listed, sort_keys=True))
    return str(target)


def restore(folder: str, target: str, version: str | None = None) -> list[str]:
    """The newest (or the given) version of an archive, each file checked against its hash."""
    v = Path(folder, version or max(p.name for p in Path(folder).iterdir() if p.is_dir()))
    listed = json.loads((v / "hashes.json").read_text())
    out = []
    for name, h in sorted(listed.items()):
        if sha256(str(v / name)) != h:
            raise ValueError(f"{name} has changed in the archive")
        Path(target).mkdir(parents=True, exist_ok=True)
        out.append(shutil.copy2(v / name, Path(target, name)))
    return out


def tarball(files: list[str], path: str) -> str:
    with tarfile.open(path, "w:gz") as t:
        for f in files:
            t.add(f, arcname=Path(f).name)
    return path


#: Rows of a report table, at most.
MOST_LINES = 10_000


def latex_table(df: DataFrame, caption: str, label: str, note: str = "", digits: int = 2) -> str:
    """A report table (a small result) as LaTeX; text is escaped and never cut. More than MOST_LINES rows are refused."""
    rows = df.limit(MOST_LINES + 1).collect()
    if len(rows) > MOST_LINES:
        raise ValueError(f"a report table has at most {MOST_LINES} rows")
    show = lambda v: f"{v:,.{digits}f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else latex(v)
    kinds = "".join("r" if t in ("int", "bigint", "double", "float") or t.startswith("decimal") else "l" for _, t in df.dtypes)
    lines = [r"\begin{table}[htbp]", r"\centering", rf"\caption{{{latex(caption)}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{kinds}}}", r"\toprule"]
    lines += [" & ".join(map(latex, df.columns)) + r" \\", r"\midrule", *(" & ".join(map(show, r)) + r" \\" for r in rows), r"\bottomrule", r"\end{tabular}"]
    if note:
        lines.append(rf"\par\footnotesize {latex(note)}")
    return "\n".join([*lines, r"\end{table}", ""])


def latex_values(values: dict[str, object]) -> str:
    """One command for each value."""
    show = lambda v: f"{v:,}" if isinstance(v, int) else latex(v)
    return "".join(rf"\providecommand{{\{k}}}{{{show(v)}}}" + "\n" for k, v in sorted(values.items()))



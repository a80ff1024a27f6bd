"""Runs: stage records with fingerprints, the modality matrix, re-clustering, comparison and verification."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.operators import bins

# The modality combinations of a run.
MODALITIES = {"tnf": ("tnf",), "cov": ("cov",), "te": ("te",), "tnfcov": ("tnf", "cov"), "tnfte": ("tnf", "te"), "covte": ("cov", "te"), "tnfcovte": ("tnf", "cov", "te")}
DEFAULT_RUNS = ("tetnfcov", "tnfcov")


def fingerprint(*parts: object) -> str:
    """Sixteen digits of a digest of JSON parts."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]


#: Parts of a table whose digests are kept apart.
CONTENT_PARTS = 64


def content(rows: DataFrame, key: str) -> dict[str, str]:
    """A digest of each part of a table, by hash of key: the number of rows and two sums of row hashes.

    It is made of what the rows hold, not of names, sizes or times of files, nor of their
    order; tasks send a row a part.
    """
    row = [F.col(c) for c in sorted(rows.columns)]
    by = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(CONTENT_PARTS)).alias("part"))
    sums = by.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*row).cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), *row)).alias("b"))
    return {str(r["part"]): fingerprint(r["n"], str(r["a"]), r["b"]) for r in sums.collect()}


def changed_parts(before: dict[str, dict[str, str]], now: dict[str, dict[str, str]]) -> dict[str, int]:
    """O3: for each table how many of its parts changed; tables without a change are left out, and all if nothing was known."""
    found = {name: sum(before[name].get(p) != parts.get(p) for p in {*before[name], *parts}) for name, parts in now.items() if name in before}
    return {name: n for name, n in found.items() if n}


@dataclass
class Checkpoints:
    """One JSON record a stage, written atomically. A record counts when its parts match and its outputs exist."""

    folder: Path
    force: bool = False

    def _path(self, stage: str) -> Path:
        return Path(self.folder) / f"{stage}.done"

    def record(self, stage: str, parts: dict, outputs: Iterable[str] = (), **metadata) -> None:
        Path(self.folder).mkdir(parents=True, exist_ok=True)
        doc = {"step": stage, "timestamp": time.time(), "parts": parts, "fingerprint": fingerprint(parts), "outputs": list(outputs), "metadata": metadata}
        new = self._path(stage).with_suffix(".new")
        new.write_text(json.dumps(doc, sort_keys=True, default=str))
        new.replace(self._path(stage))

    def load(self, stage: str) -> dict | None:
        try:
            return json.loads(self._path(stage).read_text())
        except (OSError, ValueError):
            return None

    def fresh(self, stage: str, parts: dict) -> bool:
        """Is the stage done for these parts? With force, parts don't matter; outputs always do."""
        doc = self.load(stage)
        return bool(doc) and (self.force or doc["fingerprint"] == fingerprint(parts)) and all(os.path.exists(o) for o in doc["outputs"])

    def explain(self, stage: str, parts: dict) -> list[str]:
        """O3: which parts changed since the record."""
        doc = self.load(stage)
        if doc is None:
            return ["no record"]
        old = doc["parts"]
        now = json.loads(json.dumps(parts, default=str))
        return [f"{k}: {old.get(k)!r} -> {now.get(k)!r}" for k in sorted({*old, *now}) if old.get(k) != now.get(k)] + [f"missing output {o}" for o in doc["outputs"] if not os.path.exists(o)]

    def reset(self, *stages: str) -> None:
        for s in stages:
            self._path(s).unlink(missing_ok=True)

    def inventory(self) -> list[str]:
        return sorted(p.stem for p in Path(self.folder).glob("*.done"))


def modalities(tag: str) -> tuple[str, ...]:
    """The modalities of a run tag, in any order of its parts."""
    found = tuple(m for m in ("tnf", "cov", "te") if m in tag)
    if "".join(sorted("".join(found))) != "".join(sorted(tag)):
        raise ValueError(f"unknown run {tag}; parts are tnf, cov and te")
    return found


@dataclass
class RunMatrix:
    """Runs over modality sets; each modality is encoded once, and a run that fails doesn't stop the others."""

    encode: Callable[[str], DataFrame]
    cluster: Callable[[str, dict[str, DataFrame]], DataFrame]
    encoded: dict[str, DataFrame] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)

    def run(self, tags: Iterable[str] = DEFAULT_RUNS) -> dict[str, DataFrame]:
        out: dict[str, DataFrame] = {}
        for tag in dict.fromkeys(tags):  # U3: a union that keeps its order
            try:
                for m in modalities(tag):
                    if m not in self.encoded:
                        self.encoded[m] = self.encode(m)
                out[tag] = self.cluster(tag, {m: self.encoded[m] for m in modalities(tag)})
            except Exception as e:  # noqa: BLE001 - reported with the run
                self.failed[tag] = f"{type(e).__name__}: {e}"
        return out


def next_run_folder(base: str) -> Path:
    """reclust/run_N below base; the original stays as it is."""
    root = Path(base) / "reclust"
    root.mkdir(parents=True, exist_ok=True)
    n = max([0, *(int(p.name[4:]) for p in root.glob("run_*") if p.name[4:].isdigit())]) + 1
    path = root / f"run_{n}"
    path.mkdir()
    return path


def config_changes(old: dict, new: dict) -> dict[str, tuple]:
    """The settings that differ."""
    return {k: (old.get(k), new.get(k)) for k in sorted({*old, *new}) if old.get(k) != new.get(k)}


def propagate_length_scale(config: dict, scale: float, keys: Iterable[str]) -> dict:
    """Scales the length settings that aren't set explicitly."""
    return {k: int(config["defaults"][k] * scale) for k in keys} | config.get("explicit", {})


def missing_outputs(folder: str, expected: Iterable[str]) -> list[str]:
    """Which outputs of a run are not there."""
    return [e for e in expected if not (Path(folder) / e).exists()]


def comparison(runs: dict[str, DataFrame]) -> DataFrame:
    """A line for each run: bins, contigs, binned bp, the largest bin and the N50 of bins."""
    from loamwork.operators.assembly import n50

    lines = []
    for name, rows in runs.items():
        s = bins.bin_sizes(rows)
        big = n50(s, [], "total_bp").select("n50")
        one = s.agg(F.count("*").alias("n_bins"), F.coalesce(F.sum("n_contigs"), F.lit(0)).alias("n_binned"), F.coalesce(F.sum("total_bp"), F.lit(0)).alias("binned_bp"), F.coalesce(F.max("total_bp"), F.lit(0)).alias("largest_bp"))
        lines.append(one.join(big).select(F.lit(name).alias("run"), "*"))
    out = lines[0]
    for line in lines[1:]:
        out = out.union(line)
    return out


def provenance(spark, config: dict) -> dict:
    """Versions and the digest of the settings."""
    import platform

    import pyspark

    return {"spark": spark.version, "pyspark": pyspark.__version__, "python": platform.python_version(), "config": fingerprint(config)}

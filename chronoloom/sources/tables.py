"""Sources and sinks: series files, panels, task catalogues, caches, reports and run manifests."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import config_hash
from ..operators.series import SERIES

ITEM = "item_id string, start timestamp, freq string, target array<array<double>>, variate_names array<string>, past_feat array<array<double>>"


@dataclass(frozen=True)
class Roots:
    """Where data, metadata, weights, outputs and logs lie; each from an environment variable, else under one root."""

    root: str = "."

    def path(self, name: str) -> str:
        if name not in ("data", "metadata", "weights", "outputs", "logs"):
            raise ValueError(f"no such folder: {name}")
        return os.environ.get(f"CHRONOLOOM_{name.upper()}", f"{self.root}/{name}")


def time_column(frame: DataFrame) -> str:
    """The first column named for a time or date, else the first of a time type, else the first."""
    named = [c for c in frame.columns if "time" in c.lower() or "date" in c.lower()]
    typed = [f.name for f in frame.schema.fields if isinstance(f.dataType, (T.TimestampType, T.DateType, T.TimestampNTZType))]
    return (named or typed or frame.columns)[0]


def scan_csv(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, ts, column, y): all files of a glob in long form; file is the name without its ending; no match is an error."""
    wide = spark.read.csv(pattern, header=True, inferSchema=True)
    wide = wide.withColumn("file", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1))
    time = time_column(wide.drop("file"))
    values = [c for c in wide.columns if c not in (time, "file")]
    long = wide.select("file", F.col(time).cast("timestamp").alias("ts"), *[F.col(f"`{c}`").cast("double").alias(c) for c in values])
    return long.unpivot(["file", "ts"], values, "column", "y")


def items(long: DataFrame, freq: str, univariate: bool = False) -> DataFrame:
    """Series items of (file, ts, column, y): one of each file with all its columns, or one of each column."""
    key = ["file", "column"]
    series = long.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ts", "y"))).alias("v"), F.min("ts").alias("start"))
    series = series.select(*key, "start", F.transform("v", lambda x: x["y"]).alias("values"))
    if univariate:
        return series.select(F.concat_ws("_", "file", "column").alias("item_id"), "start", F.lit(freq).alias("freq"), F.array("values").alias("target"), F.array("column").alias("variate_names"))
    whole = series.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("column", "values"))).alias("c"), F.min("start").alias("start"))
    return whole.select(F.col("file").alias("item_id"), "start", F.lit(freq).alias("freq"), F.transform("c", lambda x: x["values"]).alias("target"), F.transform("c", lambda x: x["column"]).alias("variate_names"))


def panel_of(frame: DataFrame) -> DataFrame:
    """item, channel, name, t, y of items; a name that is missing is target, or dim_<i> of several."""
    d = frame.select("item_id", "variate_names", F.size("target").alias("n"), F.posexplode("target").alias("channel", "values"))
    given = F.get("variate_names", F.col("channel"))
    name = F.coalesce(given, F.when(F.col("n") == 1, F.lit("target")).otherwise(F.concat(F.lit("dim_"), F.col("channel").cast("string"))))
    return d.select(F.col("item_id").alias("item"), "channel", name.alias("name"), F.posexplode("values").alias("t", "y")).withColumn("t", F.col("t").cast("long"))


def identities(frame: DataFrame) -> DataFrame:
    """item_id, channel, name: from the metadata columns alone."""
    return frame.select("item_id", F.posexplode("variate_names").alias("channel", "name"))


def univariate(frame: DataFrame) -> DataFrame:
    """An item of each variate, its id ending in _dim<i>."""
    d = frame.select("item_id", F.posexplode("target").alias("pos", "values"))
    return d.select(F.concat("item_id", F.lit("_dim"), F.col("pos").cast("string")).alias("item_id"), "values")


def univariate_with_others(frame: DataFrame) -> DataFrame:
    """The same, each with the other variates as covariates; items of one variate are left out."""
    d = frame.where(F.size("target") >= 2).select("item_id", F.col("target").alias("all"), F.posexplode("target").alias("pos", "values"))
    return d.select(F.concat("item_id", F.lit("_dim"), F.col("pos").cast("string")).alias("item_id"), "values", F.expr("filter(all, (x, i) -> i <> pos)").alias("covariates"))


def task_catalog(config: dict) -> list[dict]:
    """A row for each dataset and term of a task configuration: dataset, freq, term, horizon, test_length, val_length."""
    rows = []
    for key, given in config.items():
        name, _, freq = key.rpartition("/")
        for term, settings in given.get("terms", {}).items():
            rows.append({"dataset": name, "freq": freq, "term": term, "horizon": int(settings["prediction_length"]), "test_length": int(given["test_length"]), "val_length": int(given.get("val_length", given["test_length"]))})
    return rows


def load_tasks(path: str) -> list[dict]:
    import yaml

    return task_catalog(yaml.safe_load(Path(path).read_text())["datasets"])


def find_dataset(catalog: list[dict], name: str) -> str:
    """The dataset of that name, by case and punctuation if need be; none or several is an error."""
    plain = lambda s: "".join(c for c in s.lower() if c.isalnum())
    names = sorted({r["dataset"] for r in catalog})
    found = [n for n in names if n == name] or [n for n in names if plain(n) == plain(name)] or [n for n in names if plain(name) in plain(n)]
    if len(found) != 1:
        raise ValueError(f"{name!r} names {len(found)} datasets")
    return found[0]


def select_tasks(catalog: list[dict], include: list[str] | None = None, exclude: list[str] = (), terms: list[str] | None = None) -> list[dict]:
    names = {r["dataset"] for r in catalog}
    if unknown := set(exclude) - names:
        raise ValueError(f"unknown datasets are excluded: {sorted(unknown)}")
    kept = [r for r in catalog if (include is None or r["dataset"] in include) and r["dataset"] not in exclude and (terms is None or r["term"] in terms)]
    if not kept:
        raise ValueError("no task is left")
    return kept


def resolve(name: str, *levels: dict | None) -> object:
    """The first level's value of a setting that has one; an integer must be positive."""
    value = next((level[name] for level in levels if level and level.get(name) is not None), None)
    if isinstance(value, int) and value <= 0:
        raise ValueError(f"{name} must be positive")
    return value


def protocol(config: dict, dataset: str, term: str, names: list[str], given: dict | None = None, block: str = "tasks") -> dict:
    """The settings of a task by name: given ones first, then those of the term's ranges, then the dataset's block, then the dataset's entry, then its frequency's defaults (under defaults/<frequency>); one that no level has is an error."""
    own = config.get(block, {}).get(dataset, {})
    entry = config.get("datasets", {}).get(dataset, {})
    levels = (given, own.get("ranges", {}).get(term), own, entry.get("terms", {}).get(term), entry, config.get("defaults", {}).get(dataset.rpartition("/")[2]))
    found = {name: resolve(name, *levels) for name in names}
    if missing := sorted(n for n, v in found.items() if v is None):
        raise ValueError(f"{dataset} {term}: no setting of {missing}")
    return found


def target_mode(requested: str, channels: int, multivariate_model: bool) -> str:
    """univariate or multivariate, for auto by what data and model allow."""
    if requested == "auto":
        return "multivariate" if channels > 1 and multivariate_model else "univariate"
    if requested == "multivariate" and not multivariate_model:
        raise ValueError("the model takes one variate at a time")
    if requested not in ("univariate", "multivariate"):
        raise ValueError(f"no such mode: {requested}")
    return requested


def covariate_field(mode: str) -> str | None:
    fields = {"none": None, "past": "past_feat_dynamic_real", "future": "feat_dynamic_real"}
    if mode not in fields:
        raise ValueError(f"no such covariate mode: {mode}")
    return fields[mode]


def write_stage(frame: DataFrame, path: str) -> None:
    """A stage's table; one that is there already is an error."""
    frame.write.mode("errorifexists").parquet(path)


def write_report(frame: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    frame.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_json(value: dict, path: str) -> None:
    """Written beside its place, then moved there."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    draft = target.with_suffix(".draft")
    draft.write_text(json.dumps(value, sort_keys=True, indent=1))
    draft.replace(target)


class Runs:
    """Numbered runs of an identity and configuration under a folder, each with a manifest."""

    def __init__(self, root: str) -> None:
        self.root = Path(root)

    def manifests(self) -> list[dict]:
        return [json.loads(p.read_text()) | {"path": str(p.parent)} for p in sorted(self.root.rglob("manifest.json"))]

    def allocate(self, identity: dict, config: dict, mode: str = "new") -> tuple[str, str]:
        """(folder, what to do): skip a completed equal run, resume an open one, overwrite the latest, or begin a new one."""
        if mode not in ("skip", "resume", "overwrite", "new"):
            raise ValueError(f"no such mode: {mode}")
        base = self.root / config_hash(identity)[:16]
        equal = [m for m in self.manifests() if m["identity"] == identity and m["config"] == config]
        for m in reversed(equal):
            if mode == "skip" and m["status"] == "completed":
                return m["path"], "skip"
            if mode == "resume" and m["status"] == "running":
                return m["path"], "resume"
            if mode == "overwrite":
                self._write(m["path"], identity, config, "running")
                return m["path"], "overwrite"
        number = 1 + max((int(p.name.removeprefix("run_")) for p in base.glob("run_*")), default=-1)
        path = str(base / f"run_{number}")
        self._write(path, identity, config, "running")
        return path, "new"

    def _write(self, path: str, identity: dict, config: dict, status: str) -> None:
        write_json({"identity": identity, "config": config, "status": status}, f"{path}/manifest.json")

    def complete(self, path: str, artifacts: list[str]) -> None:
        """Marks a run completed; each artifact must be there and hold something."""
        for a in artifacts:
            p = Path(path) / a
            if not p.exists() or not any(f.is_file() and f.stat().st_size for f in ([p] if p.is_file() else p.rglob("*"))):
                raise ValueError(f"{a} is missing or empty")
        m = json.loads((Path(path) / "manifest.json").read_text())
        self._write(path, m["identity"], m["config"], "completed")


__all__ = ["ITEM", "SERIES", "Roots", "Runs", "covariate_field", "find_dataset", "identities", "items", "load_tasks", "panel_of", "protocol", "resolve", "scan_csv", "select_tasks", "target_mode", "task_catalog", "time_column", "univariate", "univariate_with_others", "write_json", "write_report", "write_stage"]

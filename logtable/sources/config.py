"""Configuration tables: group rules, field mappings and filter presets.

These files are written by hand. They are read whole, and field mappings become
a small DataFrame whose size the planner knows.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtable.operators.devinfo import GroupRules
from logtable.operators.presets import SCHEMA as PRESET_SCHEMA

MAPPING_SCHEMA = (
    "scope string, field_name string, mapping struct<label:string, desc:string, hide:boolean,"
    " enum:map<string,string>, unit:string, format:string, bool_normalize:boolean>"
)
BROADCAST_FIELDS = 50_000
SUFFIXES = (".yaml", ".yml", ".json")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _read_text(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path, wholetext=True).first()
    return row["value"] if row else ""


def load_config(spark: SparkSession, source: Mapping[str, Any] | str) -> Any:
    """A configuration as given, or from a file; without a suffix the first of
    ``.yaml``, ``.yml`` and ``.json`` that exists. A missing file is empty."""
    if not isinstance(source, str):
        return source
    paths = [source] if source.endswith(SUFFIXES) else [source + s for s in SUFFIXES]
    found = next((p for p in paths if _exists(spark, p)), None)
    if found is None:
        return {}
    text = _read_text(spark, found)
    if found.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError(f"reading {found} needs PyYAML") from error
    return yaml.safe_load(text) or {}


def group_rules(spark: SparkSession, source: Mapping[str, Any] | str) -> GroupRules:
    """Group rules; file entries are added to the default prefix rule."""
    config, default = load_config(spark, source), GroupRules()
    return GroupRules(
        nosplit=tuple(config.get("nosplit") or default.nosplit),
        exact={**default.exact, **(config.get("exact") or {})},
        prefix={**default.prefix, **(config.get("prefix") or {})},
    )


def java_format(shape: str) -> str:
    """A printf format for one text value, as ``format_string`` wants it.

    A verb too many and a value too many are spelled out in the result.
    """
    out, at, used = [], 0, False
    while at < len(shape):
        char = shape[at]
        at += 1
        if char != "%":
            out.append(char)
            continue
        spec = at
        while at < len(shape) and (shape[at] in "-." or shape[at].isdigit()):
            at += 1
        if at >= len(shape):
            out.append("%%!(NOVERB)")
            break
        flags, verb = shape[spec:at], shape[at]
        at += 1
        if verb == "%":
            out.append("%%")
        elif used:
            out.append(f"%%!{verb}(MISSING)")
        elif verb in "sv":
            out.append(f"%1${flags}s")
            used = True
        elif verb == "d":
            out.append(f"%%!d(string=%1${flags}s)")
            used = True
        else:
            raise ValueError(f"unsupported verb %{verb} in format {shape!r}")
    if not used:
        out.append("%%!(EXTRA string=%1$s)")
    return "".join(out)


def field_mappings(spark: SparkSession, source: Mapping[str, Any] | str) -> DataFrame:
    """``scope -> field -> mapping`` as a table with one row per field.

    Its size is known here, so it is marked for broadcast up to ``BROADCAST_FIELDS``.
    """
    rows = []
    for scope, fields in load_config(spark, source).items():
        for name, entry in (fields or {}).items():
            entry = entry or {}
            rows.append((str(scope), str(name), (
                entry.get("label") or "", entry.get("desc") or "", bool(entry.get("hide")),
                {str(k): str(v) for k, v in (entry.get("enum") or {}).items()},
                entry.get("unit") or "",
                java_format(entry["format"]) if entry.get("format") else "",
                bool(entry.get("bool_normalize")),
            )))
    table = spark.createDataFrame(rows, MAPPING_SCHEMA)
    return F.broadcast(table) if len(rows) <= BROADCAST_FIELDS else table


def read_presets(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, pattern, description)`` of a preset file; entries may be plain text.

    A missing file gives no presets.
    """
    entries = (load_config(spark, path) or {}).get("presets") or []
    rows = [
        (i, e, "") if isinstance(e, str) else (i, e.get("pattern") or "", e.get("description") or "")
        for i, e in enumerate(entries)
    ]
    return spark.createDataFrame(rows, PRESET_SCHEMA).filter(F.trim("pattern") != "")

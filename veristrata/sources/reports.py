"""Configurations, results and reports: small files of a run (S-03, S-20 to S-22, N-10)."""

from __future__ import annotations

import hashlib
import json
import re

import yaml
from pyspark.sql import SparkSession

from veristrata.sources.indexes import read_text, write_text

#: Characters of the hash that names a run; the headline metric of each task; metrics of which less is better (fixed values).
HASH = 12
HEADLINE = {"classification": "macro_f1", "retrieval": "mrr", "fast_path": "fastpath_aucc", "transliteration": "cer", "span": "token_f1", "normalization": "chrf", "faithfulness": "faithful_rate"}
LESS = ("cer", "wer", "ece")
TYPES = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool, "null": type(None)}


class Refused(ValueError):
    """A file that a run can't use."""


def canonical(value) -> bytes:
    """N-10: JSON with sorted keys, no white space, characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode("utf-8")


def digest(value) -> str:
    return hashlib.sha256(canonical(value)).hexdigest()


def read_json(spark: SparkSession, path: str):
    return json.loads(read_text(spark, path))


def write_json(spark: SparkSession, path: str, value) -> None:
    """S-03: sorted keys, two spaces, whole or not at all."""
    write_text(spark, path, json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n")


def faults(value, schema: dict, at: str = "(root)") -> list[str]:
    """What of a value breaks a JSON Schema: type, enum, const, required, properties, additionalProperties, items, pattern,
    minimum, maximum, minLength, minItems, anyOf. Other keywords are refused, not passed over."""
    names = {"type", "enum", "const", "required", "properties", "additionalProperties", "items", "pattern", "minimum", "maximum", "minLength", "minItems", "anyOf"}
    if odd := set(schema) - names - {"$schema", "$id", "title", "description", "default"}:
        raise Refused(f"schema at {at}: {sorted(odd)}")
    kinds = schema.get("type", list(TYPES))
    fits = lambda k: isinstance(value, TYPES[k]) and not (isinstance(value, bool) and k in ("integer", "number"))
    if not any(map(fits, [kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not of type {kinds}"]
    out = [f"{at}: not one of {schema['enum']}"] if "enum" in schema and value not in schema["enum"] else []
    out += [f"{at}: not {schema['const']!r}"] if "const" in schema and value != schema["const"] else []
    if "anyOf" in schema and all(faults(value, s, at) for s in schema["anyOf"]):
        out.append(f"{at}: fits none of its forms")
    under = lambda k: str(k) if at == "(root)" else f"{at}/{k}"
    if isinstance(value, dict):
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"{at}: {k} is required" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += faults(v, known[k], under(k))
            elif more is False:
                out.append(f"{at}: {k} is not known")
            elif isinstance(more, dict):
                out += faults(v, more, under(k))
    if isinstance(value, list):
        out += [f"{at}: fewer than {schema['minItems']}"] if len(value) < schema.get("minItems", 0) else []
        for i, v in enumerate(value):
            out += faults(v, schema.get("items", {}), under(i))
    if isinstance(value, str):
        out += [f"{at}: does not match {schema['pattern']}"] if "pattern" in schema and not re.search(schema["pattern"], value) else []
        out += [f"{at}: too short"] if len(value) < schema.get("minLength", 0) else []
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: under {schema['minimum']}"] if value < schema.get("minimum", value) else []
        out += [f"{at}: over {schema['maximum']}"] if value > schema.get("maximum", value) else []
    return out


def read_config(spark: SparkSession, path: str, schema: dict, defaults: dict | None = None) -> dict:
    """S-20: a YAML mapping that fits the schema, over the defaults."""
    try:
        raw = yaml.safe_load(read_text(spark, path))
    except yaml.YAMLError as e:
        raise Refused(f"{path}: not YAML: {e}") from None
    if not isinstance(raw, dict):
        raise Refused(f"{path}: not a mapping")
    if wrong := faults(raw, schema):
        raise Refused(f"{path}: {wrong[0]}")
    return {**(defaults or {}), **raw}


def run_hash(config: dict, predictions_sha256: str, lock_sha256: str | None) -> str:
    """The name of a run: its configuration, its predictions and the lock of its splits."""
    return hashlib.sha256(canonical(config) + predictions_sha256.encode() + (lock_sha256 or "nolock").encode()).hexdigest()[:HASH]


def write_result(spark: SparkSession, folder: str, result: dict) -> str:
    """S-21: results/<hash>.json; the same run has the same file."""
    path = f"{folder}/{result['config_hash']}.json"
    write_json(spark, path, result)
    return path


def number(x) -> str:
    return "—" if x is None else f"{x:.4f}"


def markdown(header: list[str], rows: list[list]) -> str:
    lines = [header, ["---"] * len(header), *rows]
    return "\n".join("| " + " | ".join(map(str, r)) + " |" for r in lines)


def results_table(results: list[dict]) -> str:
    """S-22: a row for each result: headline, baseline, difference, and what to mind."""
    rows = []
    for r in results:
        name, overall = HEADLINE.get(r.get("task")), r.get("metrics", {}).get("overall", {})
        if name is None:
            rows.append([r.get("experiment", "?"), r.get("task"), *"——————", "no headline for this task"])
            continue
        score, delta = overall.get(name), r.get("delta_vs_baseline", {}).get(name)
        base = None if score is None or delta is None else score - delta
        missing = r.get("coverage", {}).get("n_missing")
        flags = [f for f, on in (("lower is better", name in LESS), (f"{len(r.get('warnings') or [])} warning(s)", r.get("warnings")), ("dirty tree", r.get("git", {}).get("dirty")), (f"{missing} uncovered", missing)) if on]
        rows.append([r.get("experiment", "?"), r["task"], name, number(score), r.get("baseline", {}).get("name", "—"), number(base), number(delta), int(overall.get("n", 0)), ", ".join(flags) or "—"])
    return markdown(["Experiment", "Task", "Headline", "Score", "Baseline", "Base score", "Delta", "n", "Flags"], rows)


def gaps_table(results: list[dict]) -> str:
    """Native against romanised text, for languages that have both."""
    rows = [
        [r.get("experiment", "?"), lang, r["native_vs_romanized"].get("metric", "?"), *(number(e.get(k)) for k in ("native", "romanized", "gap")), int(e.get("n_native") or 0), int(e.get("n_romanized") or 0)]
        for r in results for lang, e in (r.get("native_vs_romanized", {}).get("by_lang") or {}).items() if "gap" in e
    ]
    return markdown(["Experiment", "Lang", "Metric", "Native", "Romanized", "Gap", "n native", "n roman"], rows) if rows else "_No run has both a native and a romanised cell of a language._"

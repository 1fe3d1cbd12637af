"""Scoring rules and scenes from TOML; conditions are named formulas, which the caller gives as columns."""

from __future__ import annotations

import math
import re
import tomllib

from pyspark.sql import Column, SparkSession

from barloom.functions.series import Series
from barloom.operators import scoring as sc

STAGES = ("base", "trigger", "confirm", "risk", "fail")


class RuleError(ValueError):
    """A fault of a rule file; the message names the entry."""


def read_rules(spark: SparkSession, path: str, s: Series, formulas: dict[str, Column]) -> tuple[list[sc.Rule], list[sc.Scene]]:
    """``parse_rules`` of a file (or folder with one) that Spark can read."""
    texts = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(texts) != 1:
        raise RuleError(f"{path} must hold one file")
    return parse_rules(texts[0][0], s, formulas)


def parse_rules(text: str, s: Series, formulas: dict[str, Column]) -> tuple[list[sc.Rule], list[sc.Scene]]:
    """Rules and scenes of a TOML text with the tables ``scene`` and ``rule``.

    A scene has name, direction (long or short) and observe_, trigger_, confirm_ and fail_threshold above 0. A rule has name,
    scene, stage, explain, scope_way (LAST, ANY, EACH, RECENT or CONSEC>=k), scope_windows and either ``when`` and points
    (with dist_points for EACH and RECENT, max_points for EACH) or, as kind combination, conditions (name, when,
    bonus_points) with points_by_hits, max_points and max_bonus_points. ``when`` is a key of ``formulas``. Any fault
    raises RuleError.
    """
    try:
        file = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise RuleError(f"no TOML: {e}") from e
    if unknown := set(file) - {"version", "scene", "rule"}:
        raise RuleError(f"unknown tables {sorted(unknown)}")
    scenes = [_scene(x, f"scene {i + 1}") for i, x in enumerate(file.get("scene", []))]
    _distinct([x.name for x in scenes], "scene")
    rules = [_rule(x, f"rule {i + 1}", {x.name for x in scenes}, s, formulas) for i, x in enumerate(file.get("rule", []))]
    _distinct([x.name for x in rules], "rule")
    return rules, scenes


def _distinct(names: list[str], kind: str) -> None:
    for name in names:
        if names.count(name) > 1:
            raise RuleError(f"{kind} {name} occurs twice")


def _text(entry: dict, field: str, where: str) -> str:
    value = entry.get(field)
    if not isinstance(value, str) or not value.strip():
        raise RuleError(f"{where}: {field} is missing")
    return value.strip()


def _number(entry: dict, field: str, where: str, default: float | None = None, above: float = -math.inf) -> float | None:
    value = entry.get(field, default)
    if value is None and default is None and field not in entry and above == 0:
        return None
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value) or value <= above:
        raise RuleError(f"{where}: {field} must be a finite number{' above 0' if above == 0 else ''}")
    return float(value)


def _only(entry: dict, allowed: set[str], where: str) -> None:
    if extra := set(entry) - allowed:
        raise RuleError(f"{where}: {', '.join(sorted(extra))} not allowed here")


def _scene(entry: dict, where: str) -> sc.Scene:
    name = _text(entry, "name", where)
    direction = entry.get("direction", "long")
    if direction not in ("long", "short"):
        raise RuleError(f"{where} ({name}): direction must be long or short")
    levels = [_number(entry, f"{k}_threshold", f"{where} ({name})", above=0) for k in ("observe", "trigger", "confirm", "fail")]
    if None in levels:
        raise RuleError(f"{where} ({name}): a threshold is missing")
    return sc.Scene(name, direction == "long", *levels)


def _formula(entry: dict, where: str, formulas: dict[str, Column]) -> Column:
    name = _text(entry, "when", where)
    if name not in formulas:
        raise RuleError(f"{where}: no formula {name}")
    return formulas[name]


def _table(entry: dict, way: str, where: str) -> list[tuple[int, int, float]] | None:
    if "dist_points" not in entry:
        return None
    if way not in ("EACH", "RECENT"):
        raise RuleError(f"{where}: dist_points need EACH or RECENT")
    out = []
    for i, x in enumerate(entry["dist_points"]):
        low, high = x.get("min"), x.get("max")
        if not isinstance(low, int) or not isinstance(high, int) or not 0 <= low <= high:
            raise RuleError(f"{where}: dist_points {i + 1} has no range")
        out.append((low, high, _number(x, "points", f"{where}: dist_points {i + 1}")))
    ranges = sorted(out)
    for a, b in zip(ranges, ranges[1:], strict=False):
        if a[1] >= b[0]:
            raise RuleError(f"{where}: dist_points {a[0]}-{a[1]} and {b[0]}-{b[1]} overlap")
    return out


COMMON = {"name", "scene", "stage", "explain", "scope_way", "scope_windows", "kind"}


def _rule(entry: dict, where: str, scenes: set[str], s: Series, formulas: dict[str, Column]) -> sc.Rule:
    name = _text(entry, "name", where)
    where = f"{where} ({name})"
    scene, stage, way = _text(entry, "scene", where), entry.get("stage", "base"), _text(entry, "scope_way", where)
    _text(entry, "explain", where)
    if scene not in scenes:
        raise RuleError(f"{where}: no scene {scene}")
    if stage not in STAGES:
        raise RuleError(f"{where}: no stage {stage}")
    rows = entry.get("scope_windows")
    if isinstance(rows, bool) or not isinstance(rows, int) or rows < 1:
        raise RuleError(f"{where}: scope_windows must be 1 or more")
    run = re.fullmatch(r"CONSEC>=([1-9][0-9]*)", way)
    if not run and way not in ("LAST", "ANY", "EACH", "RECENT"):
        raise RuleError(f"{where}: no scope_way {way}")
    kind = entry.get("kind", "single")
    if kind not in ("single", "combination"):
        raise RuleError(f"{where}: no kind {kind}")
    k = int(run[1]) if run else 1
    scored = (_combination if kind == "combination" else _single)(entry, where, "CONSEC" if run else way, rows, k, s, formulas)
    return sc.Rule(name, scene, stage, scored)


def _single(entry: dict, where: str, way: str, rows: int, k: int, s: Series, formulas: dict[str, Column]) -> sc.Scored:
    _only(entry, COMMON | {"when", "points", "dist_points", "max_points"}, where)
    hit, points, table = _formula(entry, where, formulas), _number(entry, "points", where, 0.0), _table(entry, way, where)
    most = _number(entry, "max_points", where, above=0)
    if most is not None and way != "EACH":
        raise RuleError(f"{where}: max_points need EACH")
    if way == "EACH":
        return sc.each(s, hit, rows, points, table or None, most)
    if way == "RECENT":
        return sc.recent(s, hit, rows, points, table or None)
    return sc.flat({"LAST": lambda: hit, "ANY": lambda: sc.any_of(s, hit, rows), "CONSEC": lambda: sc.consecutive(s, hit, rows, k)}[way](), points)


def _combination(entry: dict, where: str, way: str, rows: int, k: int, s: Series, formulas: dict[str, Column]) -> sc.Scored:
    _only(entry, COMMON | {"condition", "points_by_hits", "max_points", "max_bonus_points"}, where)
    conditions = entry.get("condition") or []
    if not conditions:
        raise RuleError(f"{where}: no condition")
    if way == "RECENT":
        raise RuleError(f"{where}: a combination has no RECENT")
    names = [_text(c, "name", f"{where}: condition {i + 1}") for i, c in enumerate(conditions)]
    _distinct(names, f"{where}: condition")
    by_hits = entry.get("points_by_hits")
    good = isinstance(by_hits, list) and len(by_hits) == len(conditions) + 1 and all(isinstance(p, int | float) and not isinstance(p, bool) and math.isfinite(p) for p in by_hits)
    if not good or by_hits[0] != 0 or not any(by_hits):
        raise RuleError(f"{where}: points_by_hits must have {len(conditions) + 1} numbers, the first 0 and not all 0")
    parts = [(_formula(c, f"{where}: condition {n}", formulas), _number(c, "bonus_points", f"{where}: condition {n}", 0.0)) for n, c in zip(names, conditions, strict=True)]
    caps = [_number(entry, f, where, above=0) for f in ("max_bonus_points", "max_points")]
    return sc.combination(s, parts, [float(p) for p in by_hits], way, rows, k, *caps)

"""JSON objects out of what models reply: judges' verdicts and planners' decisions, damaged or wrapped in prose.

Each Column function gives the object as JSON text, null where none is found. Parsing is Python, by Arrow
batches: balanced braces and repeated repair have no form in Spark expressions. `planner_strict` is native.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys that replies are known by, and other names that planners use for them.
JUDGE_KEYS = ("likert_score", "factuality_analysis", "likert_subscores")
SCORES = {
    "overall_answerability_score": ("overall_answerability_score", "overall_answerability", "answerability_score"),
    "information_density_score": ("information_density_score", "information_density", "density_score"),
}
FLAGS = {
    "numeric_evidence_required": ("numeric_evidence_required", "numeric_required"),
    "temporal_sequence_incomplete": ("temporal_sequence_incomplete", "temporal_incomplete"),
}
FOCUS = {
    "temporal_focus_clip_id": ("temporal_focus_clip_id", "temporal_focus"),
    "numeric_focus_clip_id": ("numeric_focus_clip_id", "numeric_focus"),
}
CHECKS = {"temporal_coherence_needed": "temporal", "ocr_needed": "ocr", "det_needed": "det"}
TARGETS, CLIP, REASON = ("refinement_targets", "targets"), ("clip_id", "id"), ("reasoning", "reason")

_THOUGHT = re.compile(r"(?is)<think>.*?</think>")
_NOISE = re.compile(r"(?im)^(?:thinking\.|done thinking\.|\s)+$")
_FENCED = re.compile(r"(?s)```(?:json)?\s*(\{.*?\})\s*```")
_FORMULA = re.compile(r"\{\s*[A-Za-z][^:}\n]*\}\s*=")
_LAST_COMMA = re.compile(r",\s*([}\]])")
_BAD_ESCAPE = re.compile(r'\\([^"\\/bfnrtu])')


def top_level(text: str) -> Iterator[str]:
    """The balanced {...} of a text that stand in no other, braces in strings counted too."""
    depth = begin = 0
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            begin = begin if depth else m.start()
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                yield text[begin : m.end()]


def first_json(forms: Iterator[str]) -> Any:
    for form in forms:
        try:
            return json.loads(form)
        except (ValueError, RecursionError):  # no JSON, or nested deeper than Python goes
            pass
    return None


def judge_object(reply: str | None) -> Any:
    """A fenced object first; else the balanced ones, those with the most known keys first (ties: by place)."""
    text = _NOISE.sub("", _THOUGHT.sub("", reply or ""))

    def forms() -> Iterator[str]:
        if fenced := _FENCED.search(text):
            yield fenced[1]
            yield _LAST_COMMA.sub(r"\1", fenced[1])
        for found in sorted(top_level(text), key=lambda c: -sum(f'"{k}"' in c for k in JUDGE_KEYS)):
            if not _FORMULA.search(found):
                yield found
                yield _LAST_COMMA.sub(r"\1", found).translate({0x201C: '"', 0x201D: '"', 0x2019: "'"})

    return first_json(forms())


def _first(of: dict, names: tuple[str, ...], take: Callable[[Any], Any] = lambda v: v or None, default: Any = "") -> Any:
    return next((x for n in names if n in of and (x := take(of[n])) is not None), default)


def _whole(v: Any) -> int | None:
    try:
        return None if v is None else int(v if isinstance(v, (int, float)) else str(v).strip())
    except (ValueError, OverflowError):
        return None


class NoDecision(Exception):
    """An object that parses but isn't built like a decision."""


def _target(of: dict) -> dict[str, Any]:
    checks = of.get("checks") or {}
    if not isinstance(checks, dict):
        raise NoDecision
    wanted = {k: bool(checks.get(k) or checks.get(short)) for k, short in CHECKS.items()}
    return {"clip_id": str(_first(of, CLIP)), "reasoning": _first(of, REASON), "checks": wanted}


def _canonical(of: dict) -> dict[str, Any]:
    out: dict[str, Any] = {k: _first(of, names, _whole, 0) for k, names in SCORES.items()}
    out |= {k: _first(of, names, bool, False) for k, names in FLAGS.items()}
    out |= {k: _first(of, names) for k, names in FOCUS.items()}
    listed = _first(of, TARGETS, default=[])
    return out | {"refinement_targets": [_target(t) for t in listed if isinstance(t, dict)] if isinstance(listed, list) else []}


#: A dash before a key, with the quote that the key may lack.
_DASHED = re.compile(r'(?<=[{"\s,])-\s*(?:"|(?=[A-Za-z_]))')


class Salvage:
    """What can be read off a text that is no JSON, by key."""

    def __init__(self, text: str):
        self.text = text

    def number(self, key: str) -> int:
        """The first digit; underscores of the key may be lacking or escaped."""
        spelled = key.replace("_", r"[_\\]?")
        found = re.search(rf'"{spelled}"\s*:\s*(\d)', self.text)
        return int(found[1]) if found else 0

    def yes(self, key: str) -> bool:
        return bool(re.search(rf'(?i)"{key}"\s*:\s*true', self.text))

    def quoted(self, key: str, empty: bool = True, flags: int = 0) -> str | None:
        found = re.search(rf'"{key}"\s*:\s*"([^"]{"*" if empty else "+"})"', self.text, flags)
        return found[1].strip() if found else None

    def value(self, key: str, empty: bool = True, flags: int = 0) -> str | None:
        """Quoted, else a bare word."""
        own = self.quoted(key, empty, flags)
        bare = re.search(rf'"{key}"\s*:\s*([A-Za-z0-9_.-]+)', self.text, flags) if own is None else None
        return bare[1].strip() if bare else own

    def blocks(self, key: str) -> Iterator[Salvage]:
        yield from (Salvage(b) for b in re.findall(rf'\{{[^{{}}]*"{key}"[^{{}}]*\}}', self.text))


def _salvaged(text: str) -> dict[str, Any] | None:
    """What patterns find of a planner's decision in text that is no JSON; null if that is nothing."""
    whole = Salvage(_DASHED.sub('"', _BAD_ESCAPE.sub(r"\1", text)))
    out: dict[str, Any] = {k: whole.number(k) for k in SCORES} | {k: whole.yes(k) for k in FLAGS}
    out["temporal_focus_clip_id"] = (whole.quoted("temporal_focus_clip_id") or "") if out["temporal_sequence_incomplete"] else ""
    out["numeric_focus_clip_id"] = whole.value("numeric_focus_clip_id", flags=re.I) or ""
    clips = [(b.value("clip_id", empty=False), b) for b in whole.blocks("clip_id")]
    out["refinement_targets"] = [{"clip_id": c, "reasoning": b.quoted("reasoning", empty=False) or "", "checks": {k: b.yes(k) for k in CHECKS}} for c, b in clips if c is not None]
    found = any(out[k] for k in SCORES) or out["refinement_targets"] or out["temporal_sequence_incomplete"]
    return out if found else None


def planner_object(reply: str | None) -> dict[str, Any] | None:
    """A planner's decision under its usual names: from the first object that parses, else by salvage, where also
    objects go whose parts aren't what they have to be."""
    lines = (reply or "").strip().splitlines()
    fenced = bool(lines) and lines[0].startswith("```")
    text = "\n".join(x for x in lines if not (fenced and x.strip().startswith("```"))) if fenced else (reply or "").strip()
    text = re.sub(r"(?m)^<[^\n>]+>\s*", "", re.sub(r"(?i)</?think[^>]*>", "", text))
    found = first_json(form for c in top_level(text) for form in (c, c.replace("\"'", '"').replace("'", '"')))
    try:
        out = _canonical(found) if isinstance(found, dict) else None
    except NoDecision:
        out = None
    if out and (sum(out[k] for k in SCORES) > 0 or out["refinement_targets"]):
        return out
    return _salvaged(text)


def _spelled(found: Any) -> str | None:
    """As JSON text; half a surrogate pair is escaped, since no column can hold it."""
    if found is None:
        return None
    text = json.dumps(found, ensure_ascii=False)
    return json.dumps(found) if re.search("[\ud800-\udfff]", text) else text


def _column(parse: Callable[[str | None], Any], c: Column) -> Column:
    @F.pandas_udf("string")
    def run(replies: pd.Series) -> pd.Series:
        return pd.Series([_spelled(parse(r)) for r in replies], dtype=object)

    return run(c)


def judge_json(c: Column) -> Column:
    return _column(judge_object, c)


def planner_tolerant(c: Column) -> Column:
    return _column(planner_object, c)


def planner_strict(c: Column) -> Column:
    """From the first { to the last }, code fences and a leading `json` off, false escapes and dashes before keys mended."""
    c = F.trim(F.coalesce(c, F.lit("")))
    c = F.when(F.startswith(c, F.lit("```")), F.regexp_replace(c, r"(?m)^\s*```(?:json|JSON)?\s*$", "")).otherwise(c)
    c = F.regexp_replace(F.regexp_replace(c, r'\\([^"\\/bfnrtu])', "$1"), r'([{\s,])\s*-\s*(")', "$1$2")
    block = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.to_json(F.try_parse_json(block))

"""Profiles of what to score against, from JSON or YAML (where a YAML reader is installed)."""

from __future__ import annotations

import json
from pathlib import Path

from missive.operators.score import Profile


def load_profile(path: str) -> Profile:
    """A profile file: resume_text, skills (name, weight, aliases), titles, words, exclusions, places, years and alert senders; all keys are optional."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        data = json.loads(text)
    else:
        import yaml

        data = yaml.safe_load(text)
    low = lambda name: tuple(str(x).lower() for x in data.get(name) or ())
    return Profile(
        text=data.get("resume_text") or "",
        skills=tuple((s["name"].lower(), float(s.get("weight", 1)), tuple(a.lower() for a in s.get("aliases") or ())) for s in data.get("skills") or ()),
        titles=low("target_titles"), title_words=low("title_keywords"), excluded_titles=low("exclude_titles"), excluded_words=low("exclude_keywords"),
        excluded_notes=tuple(data.get("exclude_notes") or ()), places=low("preferred_locations"), remote_ok=bool(data.get("remote_ok", True)),
        most_years=int(data.get("max_years_experience", 5)), senders=low("job_alert_senders"),
    )

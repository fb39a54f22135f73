"""Presets and saved request profiles (PF18, PF19): small settings on the driver, kept as one JSON file."""

from __future__ import annotations

import json
import os
import re
import tempfile

#: Names, modes and weights of the presets; the descriptions are our own.
PRESETS = {
    "anti_esg_contrarian": {"name": "Contrarian Anti-ESG", "description": "Prefers disputed companies or a low ESG proxy, and large ones.", "custom_esg_mode": "prefer_low", "profitability_mode": "neutral", "technical_mode": "neutral", "market_cap_mode": "prefer_large", "weighting_mode": "score_weighted", "weights": {"base_quality": 0.25, "esg_alignment": 0.30, "category_match": 0.15, "profitability_alignment": 0.15, "technical_alignment": 0.05, "market_cap_alignment": 0.10}},
    "balanced_signal": {"name": "Balanced Signal", "description": "Looks at quality and social signal alike, without a strong value norm.", "custom_esg_mode": "neutral", "profitability_mode": "neutral", "technical_mode": "prefer_high", "market_cap_mode": "neutral", "weighting_mode": "score_weighted", "weights": {"base_quality": 0.25, "esg_alignment": 0.20, "category_match": 0.20, "profitability_alignment": 0.20, "technical_alignment": 0.15, "market_cap_alignment": 0.15}},
    "classic_esg_defensive": {"name": "Classic ESG Defensive", "description": "Prefers a high ESG proxy and large, steady companies.", "custom_esg_mode": "prefer_high", "profitability_mode": "prefer_high", "technical_mode": "prefer_high", "market_cap_mode": "prefer_large", "weighting_mode": "equal", "weights": {"base_quality": 0.20, "esg_alignment": 0.30, "category_match": 0.15, "profitability_alignment": 0.20, "technical_alignment": 0.15, "market_cap_alignment": 0.15}},
}


def overlaid(base: dict, over: dict) -> dict:
    """``base`` with the values of ``over``; dictionaries within are overlaid alike."""
    nested = {k: overlaid(base[k], v) for k, v in over.items() if isinstance(v, dict) and isinstance(base.get(k), dict)}
    return base | over | nested


class Profiles:
    """Saved profiles by id; every change replaces the file at once."""

    def __init__(self, path: str) -> None:
        self.path = path

    def _read(self) -> dict[str, dict]:
        if not os.path.exists(self.path):
            return {}
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)

    def _write(self, items: dict[str, dict]) -> None:
        fd, made = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(self.path)))
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump(items, f)
        os.replace(made, self.path)

    def save(self, name: str, settings: dict, at: str, key: str | None = None, description: str | None = None) -> str:
        """Insert or update; a new profile's id (also when none has ``key``) is made of its name, with -2, -3 for those taken."""
        items = self._read()
        if key not in items:
            slug = re.sub("[^a-z0-9]+", "-", name.strip().lower()).strip("-") or "custom-profile"
            key, n = slug, 1
            while key in items:
                n += 1
                key = f"{slug}-{n}"
        items[key] = {"name": name, "description": description, "settings": settings, "created": items.get(key, {}).get("created", at), "updated": at}
        self._write(items)
        return key

    def get(self, key: str) -> dict | None:
        return self._read().get(key)

    def delete(self, key: str) -> bool:
        items = self._read()
        found = items.pop(key, None) is not None
        if found:
            self._write(items)
        return found

    def listed(self) -> list[tuple[str, dict]]:
        """The last updated first; of equal ones the last created, then the greatest name."""
        return sorted(self._read().items(), key=lambda x: (x[1]["updated"], x[1]["created"], x[1]["name"]), reverse=True)

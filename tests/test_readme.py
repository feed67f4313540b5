"""The README's coverage table names what is there."""

import re
from pathlib import Path

from tessellate.plans import registry


def test_coverage_table():
    text = Path(__file__).resolve().parents[1].joinpath("README.md").read_text().split("## Coverage")[1].split("\n## ")[0]
    rows = re.findall(r"^\| (.*?) \| (.*?) \|", text, re.M)[1:]
    claimed = set()
    for ids, _ in rows:
        for letters, low, high in re.findall(r"\b([A-Z]+)(\d+)(?:–[A-Z]+(\d+))?", ids):
            claimed |= {f"{letters}{n}" for n in range(int(low), int(high or low) + 1)}
    missing = set(re.findall(r"\b[A-Z]+\d+\b", re.search(r"Not built yet: (.*?)\. ", text)[1]))
    assert not claimed & missing
    named = {n for _, code in rows for n in re.findall(r"`([a-z]+\d+_\w+)`", code)}
    assert named <= set(registry.QUERIES), named - set(registry.QUERIES)
    # queries whose names begin with an ID stand behind it
    assert len(named) > 100

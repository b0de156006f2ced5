"""Write INVENTORY.md: every registered key, the library functions its query
calls, and how it is checked (E = DuckDB oracle, R = rows-only + tests).

usage: python tools/inventory.py > INVENTORY.md
"""
from __future__ import annotations

import inspect
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

ALIASES = {
    "D": "descriptive", "CP": "campaign", "M": "metrics", "S": "splits", "H": "models",
    "cleaning": "cleaning", "features": "features", "filters": "filters", "scoring": "scoring",
    "io": "sources.io", "fx": "plans.fixtures", "C": "functions.columns",
}

# queries that reach their operator through a shared fixture or model run
VIA = {
    "g1_stratified_split": ["splits.stratified_split (via plans.fixtures.split)"],
    "h6_model_comparison": ["models.compare_models", "models.out_of_fold", "models.fit", "metrics.score_metrics"],
    "h9_calibrated_model": ["models.calibrate", "models.fit_isotonic", "models.CalibratedModel.predict"],
    "h10_leakage_audit": ["models.leakage_audit"],
}


def calls(fn) -> list[str]:
    src = inspect.getsource(fn)
    body = src.split(":\n", 1)[1] if "def " in src else src
    found = []
    for alias, mod in ALIASES.items():
        for name in re.findall(rf"\b{alias}\.([a-z_][a-z0-9_]*)\(", body):
            if alias == "fx":
                continue
            item = f"{mod}.{name}"
            if item not in found:
                found.append(item)
    return found


def main() -> None:
    from keepwise.plans.registry import oracles, queries
    qs, ors = queries(), oracles()
    print("# Operator inventory (SURVEY §2)\n")
    print("Generated by `tools/inventory.py`. *Check*: E = exact DuckDB oracle in `oracle_sql()`;")
    print("R = rows-only for the driver, invariants asserted in `tests/`.\n")
    print("| key | library functions (under `keepwise.operators` unless noted) | check |")
    print("|---|---|---|")
    for key, fn in qs.items():
        names = VIA.get(key) or calls(fn)
        if not names and hasattr(fn, "__closure__") and fn.__closure__:
            names = ["models.predict (fitted model of the shared run)"]
        print(f"| `{key}` | {', '.join(f'`{n}`' for n in names) or '(see query module)'} | {'E' if key in ors else 'R'} |")


if __name__ == "__main__":
    main()

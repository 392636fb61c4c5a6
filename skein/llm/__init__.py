"""Operators for training-data pipelines; nothing else in the library imports this subpackage.

Python workers import the package of the function they run, so the operators' modules
are only imported when the registry is asked for.
"""

from __future__ import annotations

import importlib

#: Query name to module; each module has query(spark, sf_dir) and, where SQL can say it, ORACLE.
MODULES = {
    "op1_licence_scan": "licences",
    "op2_line_dedup": "lines",
    "op3_toxicity": "toxicity",
    "op4_url_filter": "urls",
    "op5_decontamination": "benchmark",
    "op6_near_dedup": "near",
    "op7_quality": "quality",
    "op8_mixing": "mixing",
    "op9_nearest": "ann",
    "op10_substring_dedup": "substrings",
}


def queries() -> dict:
    return {name: importlib.import_module(f"skein.llm.{module}").query for name, module in MODULES.items()}


def oracles() -> dict[str, str]:
    modules = {name: importlib.import_module(f"skein.llm.{module}") for name, module in MODULES.items()}
    return {name: m.ORACLE for name, m in modules.items() if hasattr(m, "ORACLE")}

"""All queries of the subpackage and their SQL."""

from __future__ import annotations

import importlib

from ranklab.llm import common

MODULES = ("extract", "simhash", "decontaminate", "importance", "toxicity", "vectors", "threads", "mixing",
           "substrings", "warc", "merkle", "align", "licenses")


def load() -> tuple[dict, dict]:
    import corpus_pipeline

    for name in MODULES:
        importlib.import_module(f"ranklab.llm.{name}")
    return common.QUERIES | {"pipeline": corpus_pipeline.run}, dict(common.ORACLE)

from __future__ import annotations

import ast
from pathlib import Path

import searchloom

ROOT = Path(searchloom.__file__).parent


def test_the_core_never_imports_the_llm_package():
    for f in ROOT.rglob("*.py"):
        if "llm" in f.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), f


def test_no_local_checkpoints():
    for f in ROOT.rglob("*.py"):
        assert "localCheckpoint" not in f.read_text(), f

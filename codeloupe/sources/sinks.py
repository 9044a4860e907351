"""Results as JSON and as text tables."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, Row


def plain(value: object) -> object:
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value.isoformat() if isinstance(value, datetime) else value


def to_json(result: DataFrame | dict | list) -> str:
    """One JSON document: an array of a DataFrame's rows (``[]`` for none), or the object itself."""
    return json.dumps([plain(r) for r in result.collect()] if isinstance(result, DataFrame) else plain(result), indent=2, ensure_ascii=False)


def to_text(rows: DataFrame, *names: str) -> str:
    """Columns padded to the widest value, two blanks between them; '' without rows."""
    cells = [[str(plain(v)) for v in r] for r in rows.select(*names).collect()]
    widths = [max((len(r[k]) for r in cells), default=0) for k in range(len(names))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in cells)


def tree_text(node: dict, depth: int = 0, level: int = 0) -> str:
    """A nested directory tree, indented; depth 0 shows all."""
    line = "  " * level + f"{node['name']}/  {node['files']} files, {node['symbols']} symbols"
    below = [] if depth and level >= depth else [tree_text(c, depth, level + 1) for c in node["children"]]
    return "\n".join([line, *below])


def callers_text(nodes: list[dict], level: int = 0) -> str:
    return "\n".join("  " * level + f"{n['name'] or '<file scope>'}  {n['file']}:{n['line']}" + "  (cycle)" * n["cycle"] + ("\n" + callers_text(n["callers"], level + 1) if n["callers"] else "") for n in nodes)


def impact_text(result: dict) -> str:
    """An impact simulation for reading: summary, five riskiest impacts, steps, checks, warnings."""
    out = [result["summary"]["headline"], *(f"  - {b}" for b in result["summary"]["bullets"])]
    out += ["Top impacts:", *(f"  {x['risk_score']:>3} {x['risk_tier']:<8} {x['symbol']} ({x['file']}:{x['line']}) d={x['distance']}" for x in result["impacts"][:5])]
    out += [f"Strategy: {result['planning_signals']['recommended_strategy']} ({result['planning_signals']['suggested_batch_count']} batches)"]
    out += [f"  {s['step']}. {s['action']}" for s in result["recommended_order"]]
    out += ["Checks:", *(f"  [{c['priority']}] {c['id']}: {c['why']}" for c in result["required_checks"])]
    return "\n".join(out + [f"Warning: {w}" for w in result["diagnostics"]["warnings"]])

"""What to do about a change: rules over the few aggregates of an impact simulation, on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloupe.model import CHANGE_KINDS, CROSS, DYNAMIC, MANUAL

HIGH, CRITICAL, UNSURE, MANY_CALLERS, MOST_BATCHES = 65, 85, 0.55, 3, 5
FIELDS = {
    "from": "from", "to": "to", "param": "param_name", "param_name": "param_name", "param_type_from": "param_type_from", "param_type": "param_type_to", "param_type_to": "param_type_to",
    "return_type_from": "return_type_from", "return_type": "return_type_to", "return_type_to": "return_type_to", "notes": "notes",
}
#: For each kind of change alternatives of fields, all of one of which are needed.
NEEDED = {
    "rename_symbol": [("to",)], "add_required_param": [("param_name",)], "add_optional_param": [("param_name",)], "remove_param": [("param_name",)], "param_type_change": [("param_name", "param_type_to")],
    "return_type_change": [("return_type_to",)], "visibility_change": [("from",), ("to",)], "export_change": [("from",), ("to",)], "behavior_change_hint": [("notes",)],
}


def parse_change(text: str) -> dict[str, str]:
    """``kind[:key=value...]`` as a dictionary with ``kind``; ValueError if it isn't a change."""
    kind, *tokens = (t.strip() for t in text.split(":"))
    if kind not in CHANGE_KINDS:
        raise ValueError(f"unsupported change kind {kind!r}; there are {', '.join(CHANGE_KINDS)}")
    change = {"kind": kind}
    for token in filter(None, tokens):
        key, sign, value = (t.strip() for t in token.partition("="))
        if not (sign and key and value):
            raise ValueError(f"{token!r} is no key=value")
        if key not in FIELDS:
            raise ValueError(f"unsupported key {key!r}; there are {', '.join(FIELDS)}")
        change[FIELDS[key]] = value
    if not any(all(f in change for f in group) for group in NEEDED[kind]):
        raise ValueError(f"{kind} needs {' or '.join(' and '.join(g) for g in NEEDED[kind])}")
    return change


def strategy(cross: bool, manual: bool, split: bool, risk: int) -> str:
    if manual:
        return "manual_investigation_first"
    if cross:
        return "adapter_bridge_then_migrate"
    if risk >= CRITICAL:
        return "deprecate_then_remove"
    return "adapter_bridge_then_migrate" if split else "single_pr_direct_change"


def hints(cross: bool, manual: bool, split: bool) -> list[str]:
    found = ["expand_test_plan"]
    found += ["run_cross_repo_ci", "confirm_contract_versioning"] * cross
    return found + ["prefer_non_breaking_adapter"] * split + ["notify_owners_before_edit"] * manual


def checks(start: dict, scope: dict, items: list[dict], risk: int, cross: bool, manual: bool) -> list[dict]:
    rows = [
        (True, "build-main", "build", start["repo"], "high", True, "The repository that changes has to build"),
        (True, "lint-main", "lint", start["repo"], "medium", False, "Style and static rules still hold for what was edited"),
        (bool(items), "unit-top-impact", "unit_test", f"{items[0]['repo']}:{items[0]['file']}" if items else "", "high", True, "The file most at risk needs its own tests"),
        (risk >= HIGH or scope["indirect_callers"] > 0, "integration-impacted-paths", "integration_test", start["repo"], "high", True, "The change travels through callers of callers, so paths across modules need a test"),
        (cross, "contract-cross-repo", "contract_test", "workspace", "high", True, "Another repository depends on this one, so what they agreed on needs a test"),
        (manual, "manual-risk-review", "manual_validation", start["symbol"], "high", True, "What the index can't see for sure needs a person's eyes"),
    ]
    return [dict(zip(("id", "type", "target", "priority", "blocking", "why"), r[1:], strict=True)) for r in rows if r[0]]


def notifications(start: dict, items: list[dict], cross: bool) -> list[dict]:
    found: dict[tuple[str, str], dict] = {}
    for owner in (x["owner"] for x in items if x.get("owner")):
        found.setdefault((owner["type"], owner["id"]), {"owner": owner, "reason": "They own something that the change reaches", "priority": "high"})
    for repo in sorted({x["repo"] for x in items} - {"", start["repo"]}) if cross else ():
        owner = {"id": f"repo:{repo}", "type": "service_owner", "display_name": f"Service owner for {repo}", "confidence": 0.45}
        found.setdefault((owner["type"], owner["id"]), {"owner": owner, "reason": "The change reaches into their repository", "priority": "high"})
    return [found[k] for k in sorted(found)]  # all of one priority


def steps(chosen: str, n_checks: int, notify: list[dict], items: list[dict]) -> list[dict]:
    found = []
    if notify:
        found.append({"action": "Tell the owners of what is reached first", "rationale": "Changes across repositories or owners need time to agree on", "blocking": True})
    if chosen in ("adapter_bridge_then_migrate", "deprecate_then_remove"):
        found.append({"action": "Put an adapter between old and new, and mark the old as deprecated", "rationale": "Callers go on working until they have moved", "blocking": True})
    for x in sorted(items, key=lambda x: (-x["risk_score"], -x["confidence"], x["distance"], x["id"]))[:2]:
        found.append({"action": f"Adapt {x['symbol']} in {x['file']}", "rationale": "What is most at risk moves first", "related_impact_ids": [x["id"]], "blocking": False})
    found.append({"action": f"Run the {n_checks} checks", "rationale": "Nothing merges before the checks have passed", "blocking": True})
    return [{"step": k, **s} for k, s in enumerate(found, 1)]


def alternatives(chosen: str, risk: int) -> list[dict]:
    bridge = ("adapter_bridge_then_migrate", "Keep the old form alive behind an adapter and move callers one by one", -20, ["Code that has to go again", "The move takes longer"])
    flag = ("feature_flag_rollout", "Hide the change behind a flag and switch it on step by step", -18 if risk >= CRITICAL else -10, ["Flags need care and removal", "Operations has to take part"])
    return [dict(zip(("name", "description", "expected_risk_score_delta", "tradeoffs"), a, strict=True)) for a in (bridge, flag) if a[0] != chosen]


def deciding(scored: DataFrame) -> list[dict]:
    """The few scored impacts that ``plan`` looks at, riskiest first: the first ones, and one for each repository and set of reasons."""
    risk = [F.desc("risk_score"), F.desc("confidence"), "distance"]
    first = scored.orderBy(*risk, "repo", "file", "symbol", "line").limit(1).collect() + scored.orderBy(*risk, "id").limit(2).collect()
    others = scored.groupBy("repo", "reasons").agg(F.min_by(F.struct(*scored.columns), "id").alias("x")).select("x.*").orderBy(*risk, "id").collect()
    return list({r["id"]: r.asDict() for r in (*first, *others)}.values())


def plan(start: dict, scope: dict, items: list[dict], scores: dict, warnings: list[str] | tuple = ()) -> dict:
    """Signals, steps, checks, notifications and alternatives.

    ``items`` are scored impacts, riskiest first, with their ``reasons``; what the rules look at is
    whether some item has a reason, which repositories occur, and the first two items, so it is
    enough to pass those (``deciding``).
    """
    given = {r for x in items for r in x["reasons"]}
    risk = scores["risk_score"]
    cross = scope["affected_repos"] > 1 or CROSS in given
    manual = scores["confidence"] < UNSURE or bool(given & {MANUAL, DYNAMIC}) or bool(warnings)
    split = cross or risk >= HIGH or scope["direct_callers"] >= MANY_CALLERS
    chosen = strategy(cross, manual, split, risk)
    todo, notify = checks(start, scope, items, risk, cross, manual), notifications(start, items, cross)
    return {
        "planning_signals": {
            "requires_split_migration": split,
            "requires_cross_repo_coordination": cross,
            "recommended_strategy": chosen,
            "suggested_batch_count": min(1 + split + cross + (risk >= CRITICAL) + manual, MOST_BATCHES),
            "safe_to_do_in_single_pr": chosen == "single_pr_direct_change",
            "needs_manual_review": manual,
            "agent_hints": hints(cross, manual, split),
        },
        "recommended_order": steps(chosen, len(todo), notify, items),
        "required_checks": todo,
        "notify_owners": notify,
        "alternatives": alternatives(chosen, risk),
    }

"""Schemas of the stored relations and the vocabularies of their columns.

A missing string is ``''`` and never null, in every relation.
"""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 9
WORKSPACE_VERSION = 3

SYMBOL_TYPES = ("function", "class", "method", "interface", "type_alias", "enum", "namespace", "variable")


def _struct(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


FILES = "repo_id string, path string, language string, sha256 string, mtime timestamp, size long, indexed_at timestamp"
SYMBOLS = "repo_id string, file_path string, ord int, name string, type string, start_line int, end_line int, parent string, name_tokens array<string>, body_tokens array<string>, symbol_id long, words array<array<string>>, n_words int"
REFS = "repo_id string, caller_file string, caller_name string, callee_name string, line int"
#: The full-text index: every token of a symbol once. ``words`` of the symbols says where it stands.
POSTINGS = "repo_id string, token string, file_path string, symbol_id long"
IMPORTS = "repo_id string, file_path string, import_path string, alias string, line int"
LINKS = "id long, src_repo_id string, src_symbol string, src_file string, dst_repo_id string, dst_symbol string, dst_file string, note string, created_at timestamp, meta map<string,string>"
REPOSITORIES = "id string, path string, added_at timestamp, last_indexed_at timestamp"
TABLES = {"files": FILES, "symbols": SYMBOLS, "refs": REFS, "imports": IMPORTS, "postings": POSTINGS}

#: What a parser returns for one file.
PARSED = (
    "symbols array<struct<ord: int, name: string, type: string, start_line: int, end_line: int, parent: string, body_tokens: array<string>>>, "
    "calls array<struct<ord: int, callee_name: string, line: int>>, imports array<struct<import_path: string, alias: string, line: int>>, error string"
)

CHANGE_KINDS = (
    "rename_symbol", "add_required_param", "add_optional_param", "remove_param", "param_type_change", "return_type_change", "visibility_change", "export_change", "behavior_change_hint",
)
DIRECT, INDIRECT, CROSS = "DIRECT_CALLER_SIGNATURE_MISMATCH", "INDIRECT_CALL_CHAIN_PROPAGATION", "CROSS_REPO_CONTRACT_EDGE"
NO_RUNTIME, DYNAMIC, MANUAL = "NO_RUNTIME_EVIDENCE", "POSSIBLE_DYNAMIC_DISPATCH", "MANUAL_REVIEW_REQUIRED"
REASON_WEIGHTS = {
    DIRECT: 45, CROSS: 35, "RETURN_TYPE_INCOMPATIBILITY": 30, "PARAM_TYPE_INCOMPATIBILITY": 28, "SYMBOL_RENAME_UNRESOLVED_REFERENCE": 26,
    "VISIBILITY_OR_EXPORT_BREAK": 24, "EVENT_SCHEMA_MISMATCH_RISK": 22, INDIRECT: 18, "RUNTIME_CRITICAL_PATH": 12, "HIGH_CHURN_MODULE": 10,
    "HOTSPOT_SYMBOL": 10, "LOW_TEST_COVERAGE_ZONE": 8, DYNAMIC: 8, MANUAL: 6, NO_RUNTIME: -8,
}
COMPILE, CONTRACT, BEHAVIOR = "compile_error", "contract_break", "behavioral_regression"
BREAK_WEIGHTS = {COMPILE: 22, CONTRACT: 20, "runtime_error": 18, BEHAVIOR: 14, "test_failure": 8, "unknown": 4}
EDGE_TYPES = ("call_edge", "import_edge", "contract_edge", "workspace_link", "ownership_signal", "test_signal", "symbol_relation")
STRATEGIES = ("single_pr_direct_change", "adapter_bridge_then_migrate", "deprecate_then_remove", "feature_flag_rollout", "manual_investigation_first")


class SchemaMismatchError(RuntimeError):
    """A store was written with another schema version; it has to be rebuilt."""

    def __init__(self, found: object, wanted: int):
        super().__init__(f"store has schema version {found}, this library needs {wanted}; rebuild it")
        self.found, self.wanted = found, wanted

"""What is in scope: classification of paths, reasons, kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codegrain.functions.text import extension

# Modes of regular blobs and the extensions that are parsed.
REGULAR_MODES = ("100644", "100755")
SYMLINK_MODE = "120000"
IN_SCOPE = (".c", ".cpp", ".h")
# Node types and their kinds; other preproc_* are PREPROCESSOR, the rest AST_BLOCK.
KINDS = {
    "function_definition": "FUNCTION",
    "type_definition": "TYPE",
    "struct_specifier": "TYPE",
    "union_specifier": "TYPE",
    "enum_specifier": "TYPE",
    "class_specifier": "TYPE",
    "preproc_def": "MACRO",
    "preproc_function_def": "MACRO",
    "preproc_include": "PREPROCESSOR",
    "preproc_call": "PREPROCESSOR",
    "declaration": "DECLARATION",
    "namespace_definition": "NAMESPACE",
    "template_declaration": "TEMPLATE",
    "linkage_specification": "LINKAGE",
}
# Kinds that are never merged with a neighbour.
PROTECTED = ("FUNCTION", "TYPE", "MACRO", "DECLARATION", "TEMPLATE", "LINE_WINDOW")


def classify(path: Column, mode: Column, in_scope=IN_SCOPE) -> Column:
    """IN_SCOPE for regular blobs of a parsed extension, else OUT_OF_SCOPE."""
    return F.when(mode.isin(*REGULAR_MODES) & extension(path).isin(*in_scope), "IN_SCOPE").otherwise("OUT_OF_SCOPE")


def reason(path: Column, mode: Column, by_extension: dict[str, str], default: str, symlink: str) -> Column:
    """Why a path is out of scope: links first, then the extension's reason, then the default."""
    out = F.when(mode == SYMLINK_MODE, symlink)
    for ext, text in by_extension.items():
        out = out.when(extension(path) == ext, text)
    return out.otherwise(default)


def kind(node_type: Column, kinds: dict[str, str] = KINDS) -> Column:
    table = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return F.coalesce(F.element_at(table, node_type), F.when(node_type.startswith("preproc_"), "PREPROCESSOR").otherwise("AST_BLOCK"))


def outcome(size: Column, valid_utf8: Column, n_attempts: Column, n_failed: Column, n_diagnostics: Column, n_nodes: Column) -> Column:
    """The parse outcome of a file; the first rule that holds decides."""
    return (
        F.when(size == 0, "EMPTY_SUCCESS")
        .when(~valid_utf8, "FALLBACK_NON_UTF8")
        .when(n_attempts == n_failed, "FALLBACK_ALL_FAILED")
        .when(n_diagnostics > 0, "FALLBACK_DIAGNOSTICS")
        .when(n_nodes == 0, "FALLBACK_NO_NODES")
        .otherwise("PARSE_SUCCESS")
    )

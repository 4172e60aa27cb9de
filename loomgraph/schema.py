"""Schemas of the graph tables and the small fixed tables that describe kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SPAN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("start_line", "start_col", "end_line", "end_col")])
POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
ANCHOR = T.StructType([T.StructField("side", T.StringType()), T.StructField("offset", T.DoubleType())])

#: ``parent_id`` is the lexical parent (a method's class), ``container_id`` the parent in views
#: (a method's file), ``ancestors`` the chain of containers from the root down.
NODES = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("path", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("span", SPAN),
        T.StructField("signature", T.StringType()),
        T.StructField("visibility", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("container_id", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("ancestors", T.ArrayType(T.StringType())),
        T.StructField("child_ordinal", T.LongType()),
        T.StructField("seq", T.LongType()),
    ]
)
RAW_REFS = T.StructType(
    [
        T.StructField("from_node", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("module_path", T.StringType()),
        T.StructField("span", SPAN),
        T.StructField("seq", T.LongType()),
    ]
)
EDGES = T.StructType(
    [
        T.StructField("source", T.StringType(), False),
        T.StructField("target", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("weight", T.LongType(), False),
        T.StructField("seq", T.LongType()),
    ]
)
EVENTS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("blocks", T.LongType()),
        T.StructField("message", T.StringType()),
        T.StructField("total_files", T.LongType()),
        T.StructField("total_blocks", T.LongType()),
    ]
)

# They must equal those of the application whose queries these are.

#: kind -> colour, line width, opacity, short label
EDGE_KINDS = {
    "Import": ("#6366f1", 2.5, 0.9, "Imp"),
    "FunctionCall": ("#22c55e", 2.0, 0.8, "Call"),
    "MethodCall": ("#14b8a6", 2.0, 0.8, "Meth"),
    "TypeReference": ("#f59e0b", 2.0, 0.75, "Type"),
    "Inheritance": ("#ef4444", 2.5, 0.9, "Ext"),
    "TraitImpl": ("#a855f7", 2.5, 0.85, "Impl"),
    "VariableUsage": ("#64748b", 1.5, 0.5, "Var"),
}
NO_KIND = ("#64748b", 2.0, 0.85, None)
#: kind -> colour, label prefix
BLOCK_KINDS = {
    "Function": ("#3b82f6", "fn"),
    "Class": ("#8b5cf6", "class"),
    "Struct": ("#f59e0b", "struct"),
    "Enum": ("#10b981", "enum"),
    "Trait": ("#ec4899", "trait"),
    "Interface": ("#06b6d4", "iface"),
    "Impl": ("#6366f1", "impl"),
    "Module": ("#64748b", "mod"),
    "Constant": ("#f97316", "const"),
    "TypeAlias": ("#14b8a6", "type"),
}
#: Background of directories and files, and the colour of blocks of another kind before it is darkened.
NODE_COLOURS = {"Directory": "#1e293b", "File": "#1e3a5f"}
NO_BLOCK_COLOUR = "#334155"
NODE_ICONS = {"Directory": "\U0001f4c1", "File": "\U0001f4c4"}
BLOCK_ICONS = {
    "Function": "\u0192",
    "Class": "C",
    "Struct": "S",
    "Enum": "E",
    "Trait": "T",
    "Interface": "I",
    "Impl": "\u21d2",
    "Module": "M",
    "Constant": "K",
    "TypeAlias": "\u2261",
}
NO_ICON = "\u2022"
VISIBILITIES = ("Public", "Private", "Protected", "Crate")
LANGUAGES = {"py": "Python", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "rs": "Rust"}
NODE_SIZES = {"Directory": (200.0, 60.0), "File": (180.0, 40.0), "CodeBlock": (160.0, 32.0)}
#: Suffixes tried, in order, for an import path; None: the language is unknown.
SUFFIXES = {
    "TypeScript": ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js"),
    "JavaScript": ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js"),
    "Python": (".py", "/__init__.py"),
    "Rust": (".rs", "/mod.rs"),
    None: ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js", ".py", "/__init__.py", ".rs", "/mod.rs"),
}
PADDING = {"top": 30.0, "right": 10.0, "bottom": 10.0, "left": 10.0}
TYPE_LIKE = ("TypeReference", "Inheritance", "TraitImpl")
CALL_LIKE = ("FunctionCall", "MethodCall")
MAX_WEIGHT = 4294967295


def edge_kinds(spark: SparkSession) -> DataFrame:
    """One row per edge kind: kind, colour, width, alpha, short_label."""
    return spark.createDataFrame(
        [(k, *v) for k, v in EDGE_KINDS.items()], "kind string, colour string, width double, alpha double, short_label string"
    )


def check_edge_kinds(kinds) -> list[str]:
    """``kinds`` as a list; an unknown name raises ``ValueError``."""
    kinds = list(kinds)
    if unknown := sorted(set(kinds) - EDGE_KINDS.keys()):
        raise ValueError(f"unknown edge kinds: {', '.join(unknown)}")
    return kinds

"""Column expressions for levels of detail, colours, labels and sizes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.schema import BLOCK_ICONS, BLOCK_KINDS, EDGE_KINDS, NO_BLOCK_COLOUR, NO_ICON, NO_KIND, NODE_COLOURS, NODE_ICONS, NODE_SIZES

FAINTEST = 0.05


@dataclass(frozen=True)
class DetailSettings:
    minimap_opacity: float = 0.2
    overview_opacity: float = 0.5
    edges_in_minimap: bool = True
    hidden_at_overview: tuple[str, ...] = field(default=("VariableUsage",))


def _choose(key: Column, table: dict[str, object], default: object) -> Column:
    out = F.when(F.lit(False), F.lit(default))
    for name, value in table.items():
        out = out.when(key == name, F.lit(value))
    return out.otherwise(F.lit(default))


def level_of_detail(scale: Column) -> Column:
    return F.when(scale < 0.05, "minimap").when(scale < 0.2, "overview").otherwise("detail")


def opacity_factor(level: Column, settings: DetailSettings = DetailSettings()) -> Column:
    minimap = settings.minimap_opacity if settings.edges_in_minimap else 0.0
    return F.when(level == "minimap", F.lit(minimap)).when(level == "overview", F.lit(settings.overview_opacity)).otherwise(F.lit(1.0))


def width_factor(level: Column) -> Column:
    return F.when(level == "minimap", F.lit(0.5)).when(level == "overview", F.lit(0.75)).otherwise(F.lit(1.0))


def hidden_at(kind: Column, level: Column, settings: DetailSettings = DetailSettings()) -> Column:
    return F.coalesce((level == "overview") & kind.isin(*settings.hidden_at_overview), F.lit(False))


def edge_colour(kind: Column) -> Column:
    return _choose(kind, {k: v[0] for k, v in EDGE_KINDS.items()}, NO_KIND[0])


def edge_width(kind: Column) -> Column:
    return _choose(kind, {k: v[1] for k, v in EDGE_KINDS.items()}, NO_KIND[1])


def edge_alpha(kind: Column) -> Column:
    return _choose(kind, {k: v[2] for k, v in EDGE_KINDS.items()}, NO_KIND[2])


def edge_label(kind: Column) -> Column:
    return _choose(kind, {k: v[3] for k, v in EDGE_KINDS.items()}, None)


def block_colour(kind: Column) -> Column:
    return _choose(kind, {k: v[0] for k, v in BLOCK_KINDS.items()}, None)


def darkened(colour: Column, share: float = 0.25) -> Column:
    """``#rrggbb`` with every channel times ``share``, rounded down."""
    channel = lambda at: F.lower(
        F.lpad(F.hex(F.floor(F.conv(F.substring(colour, at, 2), 16, 10).cast("long") * F.lit(share)).cast("long")), 2, "0")
    )
    return F.concat(F.lit("#"), channel(2), channel(4), channel(6))


def node_colour(type_: Column, kind: Column) -> Column:
    """Background of a node; that of a block is its colour, darkened."""
    block = darkened(F.coalesce(block_colour(kind), F.lit(NO_BLOCK_COLOUR)))
    return F.when(type_ == "CodeBlock", block).otherwise(_choose(type_, NODE_COLOURS, None))


def node_icon(type_: Column, kind: Column) -> Column:
    return F.when(type_ == "CodeBlock", _choose(kind, BLOCK_ICONS, NO_ICON)).otherwise(_choose(type_, NODE_ICONS, None))


def node_label(type_: Column, kind: Column, name: Column) -> Column:
    prefix = _choose(kind, {k: v[1] for k, v in BLOCK_KINDS.items()}, None)
    return F.when(type_ == "CodeBlock", F.concat_ws(" ", prefix, name)).otherwise(name)


def label_shown(type_: Column, level: Column) -> Column:
    return F.when(type_ == "CodeBlock", level == "detail").otherwise(level != "minimap")


def node_size(type_: Column) -> Column:
    width = _choose(type_, {k: v[0] for k, v in NODE_SIZES.items()}, None)
    height = _choose(type_, {k: v[1] for k, v in NODE_SIZES.items()}, None)
    return F.struct(width.alias("width"), height.alias("height"))


def tooltip(type_: Column, kind: Column, name: Column, signature: Column, language: Column, path: Column, n_children: Column) -> Column:
    return (
        F.when(type_ == "CodeBlock", F.concat_ws(" | ", F.concat_ws(" ", kind, name), signature))
        .when(type_ == "File", F.concat_ws(" | ", F.coalesce(language, F.lit("unknown")), path))
        .otherwise(F.concat(n_children.cast("string"), F.lit(" items")))
    )


def percent_to_share(text: Column) -> Column:
    """A percentage as typed, its leading integer, as a share."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int") / F.lit(100.0)

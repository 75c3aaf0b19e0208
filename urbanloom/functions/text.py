"""Text, path and record column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    """Null for empty text and for the texts that stand for missing values."""
    return F.when(F.trim(c.cast("string")).isin("", "nan", "NaN", "None", "null"), None).otherwise(c)


def first_filled(columns: list[Column]) -> Column:
    """The first column that is neither null nor empty, untrimmed."""
    return F.coalesce(*[F.when(c.cast("string") != "", c.cast("string")) for c in columns])


def display_name(name: Column, address: Column, street: Column, kind: Column, category: Column, node_id: Column) -> Column:
    """Name, else (unless an image) address, street, type, category, else the id as text."""
    rest = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in (address, street, kind, category)])
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.when(F.coalesce(kind, F.lit("")) != "mapillary", rest), node_id.cast("string"))


def crossing_name(name: Column) -> Column:
    """``Complex_Crossing_a_b_c`` to ``Complex Crossing of a and b c``, ``Crossing_a_b`` to ``Intersection of a and b``."""
    complex_ = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "^Complex_Crossing_", ""), "^([^_]*)_", "$1 and "), "_", " ")
    plain = F.regexp_replace(name, "^Crossing_([^_]*)_(.*)$", "Intersection of $1 and $2")
    return F.when(name.startswith("Complex_Crossing_"), F.concat(F.lit("Complex Crossing of "), complex_)).otherwise(plain)


def edge_weight(*columns: Column, default: float = 1.0) -> Column:
    """The first positive column, else ``default``."""
    return F.coalesce(*[F.when(c > 0, c.cast("double")) for c in columns], F.lit(default))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def rewrite_paths(paths: Column, prefix: str) -> Column:
    """Non-blank paths become prefix + base name; others stay."""
    return F.transform(paths, lambda p: F.when(F.trim(p) != "", F.concat(F.lit(prefix), basename(p))).otherwise(p))


def image_id(path: Column) -> Column:
    """Base name without its extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def image_key(path: Column) -> Column:
    """Lower-cased base name with its extension; null for empty text."""
    return F.nullif(F.lower(basename(F.trim(path))), F.lit(""))


def bracket_contents(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[([^\]]*)\]"), 1)


def split_caption(text: Column, mark: str = "**Summarization:**") -> Column:
    """struct(before, after) of the mark, trimmed; nulls without it."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.struct(F.trim(F.substr(text, F.lit(1), at - 1)).alias("before"), F.trim(F.substr(text, at + len(mark))).alias("after")))


def fingerprint(columns: dict[str, Column]) -> Column:
    """md5 of the row as JSON with sorted keys."""
    return F.md5(F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)])))


#: Words that do not tell streets apart.
STREET_WORDS = ("street", "st", "road", "rd", "avenue", "ave")


def same_street(a: Column, b: Column, stopwords: tuple[str, ...] = STREET_WORDS) -> Column:
    """Equal, one within the other, or equal without street words; null or blank is false."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    core = lambda c: F.array_join(F.filter(F.split(c, " "), lambda w: ~w.isin(*stopwords)), " ")
    return F.coalesce((x != "") & (y != "") & ((x == y) | x.contains(y) | y.contains(x) | (core(x) == core(y))), F.lit(False))


def format_step(length: Column, direction: Column) -> Column:
    """``(12.0m, 94°(E))``, with what is known; ``()`` if nothing is."""
    return F.concat(F.lit("("), F.concat_ws(", ", F.when(length.isNotNull(), F.format_string("%.1fm", length)), direction), F.lit(")"))


def format_triple(source: Column, middle: Column, target: Column) -> Column:
    return F.concat(F.lit("("), F.concat_ws(", ", source, middle, target), F.lit(")"))


def clean_path_text(path: Column) -> Column:
    """Of neighbouring two-field tuples the last stays; triples (two commas) stay."""
    parts = F.split(path, " -> ")
    pair = lambda p: F.coalesce(p.rlike(r"^\([^,]*,[^,]*\)$"), F.lit(False))
    return F.array_join(F.filter(parts, lambda p, i: ~(pair(p) & pair(F.get(parts, i + 1)))), " -> ")


def complexity(edge_types: Column, directions: Column) -> Column:
    """Triples + 2 * crossings + 0.5 * directions."""
    return F.size(edge_types) + 2 * F.size(F.filter(edge_types, lambda t: t == "crossing")) + 0.5 * F.size(F.array_compact(directions))


def node_text(fields: dict[str, Column], lon: Column, lat: Column) -> Column:
    """``Name: .., Category: .., Coordinates: (lon, lat)`` of the fields that are filled, coordinates with 6 decimals."""
    parts = [F.when(blank_to_null(c).isNotNull(), F.concat(F.lit(f"{k}: "), c.cast("string"))) for k, c in fields.items()]
    return F.concat_ws(", ", *parts, F.format_string("Coordinates: (%.6f, %.6f)", lon, lat))

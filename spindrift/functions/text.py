"""Text functions over typed columns: cleaning, entity texts, image urls, word counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

_EDGE = r"^[\s\x1c-\x1f\x85\xa0]+|[\s\x1c-\x1f\x85\xa0]+$"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, _EDGE, "")


def clean(c: Column) -> Column:
    """Stripped; null becomes empty."""
    return F.coalesce(strip(c), F.lit(""))


def list_text(c: Column, separator: str) -> Column:
    """Stripped non-empty members, joined."""
    return F.coalesce(F.array_join(F.filter(F.transform(c, clean), lambda x: x != ""), separator), F.lit(""))


def map_text(c: Column, separator: str, missing: str | None = "") -> Column:
    """``key: value`` for each entry whose value is not empty, joined; ``missing`` for null."""
    entries = F.filter(F.map_entries(c), lambda e: clean(e["value"]) != "")
    return F.coalesce(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), clean(e["value"]))), separator), F.lit(missing))


def value_text(c: Column, kind: DataType, separator: str = " ") -> Column:
    """A column of any depth as text: members of lists, ``key: text`` of maps and structs, each where the text isn't empty.

    The expression follows the type ``kind``; null and NaN are empty, True and False are written so."""
    name = kind.typeName()
    joined = lambda texts: strip(F.array_join(F.filter(texts, lambda x: x != ""), separator))
    entry = lambda key, text: F.when(text != "", F.concat(key, F.lit(": "), text)).otherwise("")
    if name == "array":
        out = joined(F.transform(c, lambda x: value_text(x, kind.elementType, separator)))
    elif name == "map":
        out = joined(F.transform(F.map_entries(c), lambda e: entry(e["key"].cast("string"), value_text(e["value"], kind.valueType, separator))))
    elif name == "struct":
        out = joined(F.array(*[entry(F.lit(f.name), value_text(c.getField(f.name), f.dataType, separator)) for f in kind.fields]))
    elif name == "boolean":
        out = F.initcap(c.cast("string"))
    elif name in ("double", "float"):
        out = F.when(~F.isnan(c), c.cast("string"))
    else:
        out = strip(c.cast("string"))
    return F.when(c.isNotNull(), F.coalesce(out, F.lit(""))).otherwise("")


def details_text(c: Column, separator: str = "\n") -> Column:
    """A JSON object as ``key: value`` entries; a text that isn't JSON stays as it is."""
    given = clean(c)
    return F.when(given.isin("", "{}"), "").otherwise(F.coalesce(map_text(F.from_json(F.when(F.get_json_object(given, "$").isNotNull(), given), "map<string, string>"), separator, None), given))


def word_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"\S+"))


def join_non_empty(parts: Sequence[Column], separator: str) -> Column:
    return F.concat_ws(separator, *[F.when(p != "", p) for p in parts])


def entity_text(df: DataFrame, fields: Sequence[str]) -> Column:
    """Cleaned fields in order, one a line, as are their members if they are nested; fields that df lacks are skipped."""
    return join_non_empty([value_text(F.col(f), df.schema[f].dataType, "\n") for f in fields if f in df.columns], "\n")


def labelled_entity_text(df: DataFrame, fields: Sequence[str]) -> Column:
    """Paragraphs ``Field Name: text``.  Lists are joined by line breaks for features and description, else by " > "."""
    parts = []
    for f in (f for f in fields if f in df.columns):
        kind, within = df.schema[f].dataType.typeName(), "\n" if f in ("features", "description", "details") else " > "
        plain = details_text(F.col(f)) if (f, kind) == ("details", "string") else clean(F.col(f))
        value = list_text(F.col(f), within) if kind == "array" else map_text(F.col(f), within) if kind == "map" else plain
        parts.append(F.when(value != "", F.concat(F.lit(f.replace("_", " ").title() + ": "), value)))
    return F.concat_ws("\n\n", *parts)


def add_entity_text(df: DataFrame, fields: Sequence[str], min_words: int = 0, labelled: bool = False) -> DataFrame:
    out = df.withColumn("entity_text", (labelled_entity_text if labelled else entity_text)(df, fields))
    return out.filter(word_count(F.col("entity_text")) >= min_words) if min_words > 0 else out


def encoder_texts(df: DataFrame, columns: Sequence[str], separator: str = "\n", fallback: Sequence[str] = ()) -> Column:
    """Non-empty columns joined; where all are empty, the fallback columns joined by " | "."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    main = join_non_empty([clean(F.col(c)) for c in columns], separator)
    return F.when(main != "", main).otherwise(join_non_empty([clean(F.col(c)) for c in fallback if c in df.columns], " | "))


IMAGES = "array<struct<hi_res: string, large: string, thumb: string>>"


def parse_images(c: Column) -> Column:
    """JSON text to image structs; a text that isn't JSON is the address of a large image."""
    given = clean(c)
    plain = F.array(F.struct(F.lit(None).cast("string").alias("hi_res"), given.alias("large"), F.lit(None).cast("string").alias("thumb")))
    none = F.array().cast(IMAGES)
    return (
        F.when(given.isin("", "[]", "nan"), none)
        .when(given.startswith("["), F.coalesce(F.from_json(given, IMAGES), plain))
        .when(given.startswith("{"), F.coalesce(F.from_json(F.concat(F.lit("["), given, F.lit("]")), IMAGES), plain))
        .otherwise(plain)
    )


def image_urls(images: Column) -> Column:
    """Addresses by image, best first, each once."""
    flat = F.flatten(F.transform(images, lambda i: F.array(clean(i["hi_res"]), clean(i["large"]), clean(i["thumb"]))))
    return F.array_distinct(F.filter(flat, lambda u: u != ""))

"""What a page shows: blocks as render models, visualisations, citations put into texts, files' content types.

A block has ``block_type``, ``title``, ``content``, ``data`` (map of text fields) and the ids it refers to.
Fields that a type doesn't have are null.  An empty text counts as missing, as it does where a default stands behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Content types by a file's ending, and for all others.
CONTENT_TYPES = {
    ".cog": "image/tiff",
    ".tif": "image/tiff",
    ".tiff": "image/tiff",
    ".mbtiles": "application/vnd.mapbox-vector-tile",
    ".gpkg": "application/geopackage+sqlite3",
    ".geojson": "application/geo+json",
}
ANY_CONTENT = "application/octet-stream"

#: The fields of a visualisation's data, with what stands for a missing one.
VISUALISATION = {"title": "", "captionDe": "", "captionEn": "", "content": "", "type": "map", "imageCategory": "", "imageScenario": "", "imageIndicator": "", "imageId": ""}


def _first(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def _data(name: str) -> Column:
    return F.col("data")[name]


def model(blocks: DataFrame, key: list[str]) -> DataFrame:
    """(key, type, title, content, text, author, role, variant, rest) of blocks (key, block_type, title, content, data).

    Each type takes its fields from the block or its data; ``rest`` is the whole data of types that carry it along.
    """
    kind, empty = F.col("block_type"), F.lit("")
    title, content = F.col("title"), F.col("content")
    either = lambda name, own: _first(own, _data(name))

    def by_type(cases: dict[tuple[str, ...], Column | None], other: Column | None = None) -> Column:
        out = F.lit(None).cast("string") if other is None else other
        for kinds, value in cases.items():
            out = F.when(kind.isin(*kinds), F.lit(None).cast("string") if value is None else value).otherwise(out)
        return out

    none = {("markdown", "quote", "statistics", "timeline"): None}
    return blocks.select(
        *key,
        kind.alias("type"),
        by_type({**none, ("visualization",): title, ("callout",): F.coalesce(either("title", title), empty), ("animated-quote",): F.coalesce(_first(title), empty), ("climate-dashboard",): either("title", title)}, either("title", title)).alias("title"),
        by_type(
            {("statistics", "timeline", "climate-dashboard"): None, ("visualization",): content, ("markdown", "callout"): F.coalesce(either("content", content), empty), ("quote",): _data("content"), ("animated-quote",): F.coalesce(_first(content), empty)},
            either("content", content),
        ).alias("content"),
        by_type({("animated-quote",): F.coalesce(_first(_data("text")), empty)}).alias("text"),
        by_type({("quote",): _data("author"), ("animated-quote",): F.coalesce(_first(_data("author")), empty)}).alias("author"),
        by_type({("quote",): _data("role"), ("animated-quote",): F.coalesce(_first(_data("role")), empty)}).alias("role"),
        by_type({("callout",): F.coalesce(_first(_data("variant")), F.lit("default"))}).alias("variant"),
        F.when(~kind.isin("markdown", "callout", "quote", "statistics", "timeline", "animated-quote", "climate-dashboard"), F.col("data")).alias("rest"),
    )


def resolved(blocks: DataFrame, key: list[str], ids: str, references: DataFrame) -> DataFrame:
    """(key, references): a block's references (id and more columns), in the order of its ids; unknown ids are left out, repeated ones stay."""
    asked = blocks.select(*key, F.posexplode(ids).alias("__at", "id"))
    whole = references.select("id", F.struct(*references.columns).alias("__ref"))
    found = asked.join(whole, "id").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("__at", "__ref"))).alias("__all"))
    kind = whole.schema["__ref"].dataType.simpleString()
    return blocks.select(*key).join(found.select(*key, F.col("__all.__ref").alias("references")), key, "left").withColumn("references", F.coalesce("references", F.expr(f"cast(array() as array<{kind}>)")))


def visualisations(blocks: DataFrame, key: list[str]) -> DataFrame:
    """the visualisations among the blocks, each field of their data with its default."""
    fields = [F.coalesce(_first(_data(name)), F.lit(default)).alias(name) for name, default in VISUALISATION.items()]
    return blocks.where("block_type = 'visualization'").select(*key, *fields)


def cited_at(text: Column, place: Column, name: Column) -> Column:
    r"""the text with ``\cite{name}`` put in after its first ``place`` characters; beyond the end it is put there."""
    return F.concat(F.substring(text, F.lit(1), place), F.lit("\\cite{"), name, F.lit("}"), F.substring(text, place + 1, F.length(text)))


def file_content_type(file: Column) -> Column:
    """the content type by a file's ending, in any case."""
    ending = F.lower(F.regexp_extract(file, r"(\.[^./]*)$", 1))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in CONTENT_TYPES.items() for x in pair)), ending), F.lit(ANY_CONTENT))

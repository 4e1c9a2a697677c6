"""Stories, blocks, references: nested reads, pairing, numbering, order changes, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nested_blocks(blocks: DataFrame, links: DataFrame, references: DataFrame) -> DataFrame:
    """Blocks with a list of their references in the order of the links (position), empty where there are none."""
    found = F.sort_array(F.collect_list(F.struct("position", "reference_id", "title")))
    refs = links.join(references, "reference_id").groupBy("block_id").agg(F.transform(found, lambda x: F.struct(x["reference_id"].alias("reference_id"), x["title"].alias("title"))).alias("references"))
    empty = F.array().cast("array<struct<reference_id:bigint,title:string>>")
    return blocks.join(refs, "block_id", "left").withColumn("references", F.coalesce("references", empty))


def paired(blocks: DataFrame, story: str, left: str, right: str) -> DataFrame:
    """The two languages' blocks side by side on order_index; of repeated indexes the first counts."""
    w = Window.partitionBy(story, "language", "order_index").orderBy("block_id")
    first = blocks.where(F.col("language").isin(left, right)).withColumn("__n", F.row_number().over(w)).where("__n = 1")
    side = lambda lang: first.where(F.col("language") == lang).select(story, "order_index", F.col("block_type").alias(f"type_{lang}"), F.col("block_id").alias(f"block_{lang}"))
    both = side(left).join(side(right), [story, "order_index"], "full_outer")
    return both.withColumn("block_type", F.coalesce(f"type_{left}", f"type_{right}")).drop(f"type_{left}", f"type_{right}")


CITE = r"\\cite\{([^}]+)\}"


def citations(content: Column) -> Column:
    r"""different ids of \cite{id}, in the order of their first use."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(CITE), F.lit(1)))


def citation_numbers(blocks: DataFrame, document: str, order: str, content: str) -> DataFrame:
    """Numbers of references by first appearance over a whole document."""
    found = blocks.select(document, order, F.posexplode(F.regexp_extract_all(content, F.lit(CITE), F.lit(1))).alias("pos", "ref"))
    first = found.groupBy(document, "ref").agg(F.min(F.struct(order, "pos")).alias("at"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy(document).orderBy("at"))).drop("at")


def cited_first(references: DataFrame, numbers: DataFrame, document: str, ref: str, position: str) -> DataFrame:
    """Each document's cited references by number, then its others in their own order."""
    full = references.join(numbers.select(F.col("ref").alias(ref), "number", document), [document, ref], "left")
    return full.withColumn("rank", F.row_number().over(Window.partitionBy(document).orderBy(F.col("number").asc_nulls_last(), position)))


def numbered_text(content: Column, refs: Column) -> Column:
    r"""F16: known citations (an array of ids in the order of their numbers) as [n], unknown ones as they are."""
    parts = F.split(content, r"(?=\\cite\{[^}]+\})", -1)

    def one(part):
        ref = F.regexp_extract(part, r"^\\cite\{([^}]+)\}", 1)
        at = F.array_position(refs, ref)
        rest = F.regexp_replace(part, r"^\\cite\{[^}]+\}", "")
        return F.when((ref != "") & (at > 0), F.concat(F.lit("["), at.cast("string"), F.lit("]"), rest)).otherwise(part)

    return F.array_join(F.transform(parts, one), "")


def base_id_first(author: Column, year: Column) -> Column:
    """the first word of ASCII letters that a blank or the end follows, else the whole name without blanks."""
    word = F.regexp_extract(author, "([A-Za-z]+)(?: |$)", 1)
    return F.concat(F.when(word != "", word).otherwise(F.regexp_replace(author, r"\s", "")), year.cast("string"))


def base_id_last(author: Column, year: Column) -> Column:
    """the last word of ASCII letters at the end of the name, else the name's letters."""
    word = F.regexp_extract(author, " ([A-Za-z]+)$", 1)
    return F.concat(F.when(word != "", word).otherwise(F.regexp_replace(author, "[^A-Za-z]", "")), year.cast("string"))


def unique_ids(df: DataFrame, base: str, order: list[str], out: str = "readable_id") -> DataFrame:
    """-2, -3 and so on for the later rows of a base id."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return df.withColumn("__n", n).withColumn(out, F.when(F.col("__n") == 1, F.col(base)).otherwise(F.concat(base, F.lit("-"), F.col("__n")))).drop("__n")


def sanitised(text: Column) -> Column:
    """letters, digits and single inner hyphens, 50 at most."""
    out = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9-]", ""), "-+", "-")
    return F.substring(F.regexp_replace(out, "^-|-$", ""), 1, 50)


def shifted(df: DataFrame, order: str, at: int, by: int = 1) -> DataFrame:
    """Open (or close) a gap at a position."""
    return df.withColumn(order, F.when(F.col(order) >= at, F.col(order) + by).otherwise(F.col(order)))


def swapped(df: DataFrame, order: str, a: int, b: int) -> DataFrame:
    """Two positions exchanged."""
    return df.withColumn(order, F.when(F.col(order) == a, b).when(F.col(order) == b, a).otherwise(F.col(order)))


def next_position(df: DataFrame, by: str, order: str) -> DataFrame:
    """One after the last."""
    return df.groupBy(by).agg((F.coalesce(F.max(order), F.lit(0)) + 1).alias("next_index"))


def bulk_insert(stories: DataFrame, blocks: str) -> DataFrame:
    """Q-C6: an array of blocks as rows with their position from 1."""
    return stories.select("*", F.posexplode(blocks).alias("__p", "block")).withColumn("order_index", F.col("__p") + 1).drop("__p", blocks)


#: What the fields of a block may hold.
BLOCK_TYPES = (
    "markdown", "callout", "visualization", "animated-quote", "animated-statistics", "climate-timeline", "climate-dashboard", "temperature-spiral",
    "interactive-callout", "impact-comparison", "kpi-showcase", "climate-timeline-minimal", "climate-infographic", "interactive-map",
)
CALLOUTS = ("success", "warning", "info", "error")
VISUALS = ("map", "chart", "trend", "gauge")
CATEGORIES = ("hazard", "exposition", "relevance", "risk", "risk-clusters")
SCENARIOS = ("current", "conservative", "moderate", "severe", "none", "all")
INDICATORS = ("freight", "hrst", "gdp", "population", "combined", "none")
YEARS, TURNS, PERCENT = (1850, 2100), (1, 20), (0, 100)
TITLE, CONTENT, STORY = 200, 5000, 3

#: The fields of a block's payload that rules look at; others stay in the text.
PAYLOAD = """variant string, text string, author string, type string, imageCategory string, imageScenario string, imageIndicators array<string>,
    startYear double, endYear double, rotations double, stats array<struct<label:string,value:string,color:string>>,
    events array<struct<year:double,title:string,color:string>>, metrics array<struct<title:string,value:string,progress:double>>"""


def is_colour(text: Column) -> Column:
    """# and three or six hexadecimal digits."""
    return text.rlike("^#([A-Fa-f0-9]{6}|[A-Fa-f0-9]{3})$")


def within(v: Column, bounds: tuple[int, int]) -> Column:
    """F20."""
    return v.between(*bounds)


def is_json(text: Column) -> Column:
    """whether a text can be parsed; null is nothing to parse."""
    return text.isNull() | F.try_parse_json(text).isNotNull()


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _zero(c: Column) -> Column:
    """Absent, as a form sees it: null or 0."""
    return F.coalesce(c, F.lit(0.0)) == 0


def problems(block_type: Column, language: Column, order_index: Column, title: Column, content: Column, data: Column, story: Column | None = None) -> Column:
    """array of {field, rule} of a block, empty when all is well; data is the payload's JSON text.

    As in a form, order_index 0 counts as not filled in.
    """
    d = F.from_json(data, PAYLOAD)
    entry = lambda field, rule, bad: F.when(F.coalesce(bad, F.lit(False)), F.array(F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule"))))
    of = lambda kind, *found: [F.when(block_type == kind, F.coalesce(x, F.expr(_NONE))) for x in found]
    one_of = lambda c, allowed: ~F.coalesce(c.isin(*allowed), F.lit(False))

    def each(field: str, *rules):
        """A list that may not be empty, and rules for each of its entries: (field, rule, condition of the entry)."""

        def one(x, i):
            found = [F.when(F.coalesce(bad(x), F.lit(False)), F.struct(F.concat_ws(".", F.lit(f"data.{field}"), i.cast("string"), F.lit(name)).alias("field"), F.lit(rule).alias("rule"))) for name, rule, bad in rules]
            return F.filter(F.array(*found), lambda y: y.isNotNull())

        listed = d[field]
        return F.when(F.coalesce(F.size(listed), F.lit(0)) <= 0, entry(f"data.{field}", "required", F.lit(True))).otherwise(F.flatten(F.transform(listed, one)))

    need = lambda name: (name, "required", lambda x: _blank(x[name]))
    hue = ("color", "not a colour", lambda x: ~_blank(x["color"]) & ~is_colour(x["color"]))
    year = ("year", "out of range", lambda x: _zero(x["year"]) | ~within(x["year"], YEARS))
    found = [
        entry("block_type", "required", _blank(block_type)),
        entry("language", "required", _blank(language)),
        entry("order_index", "required", _zero(order_index)),
        entry("story_id", "too short", (story != "") & (F.length(F.trim(story)) < STORY)) if story is not None else F.expr(_NONE),
        entry("block_type", "unknown", ~_blank(block_type) & one_of(block_type, BLOCK_TYPES)),
        entry("order_index", "negative", order_index < 0),
        entry("data", "not JSON", ~is_json(data)),
        entry("title", "too long", F.length(title) > TITLE),
        entry("content", "too long", F.length(content) > CONTENT),
        *of("callout", entry("data.variant", "unknown", one_of(d["variant"], CALLOUTS))),
        *of("interactive-callout", entry("data.variant", "unknown", one_of(d["variant"], CALLOUTS))),
        *of("animated-quote", entry("data.text", "required", _blank(d["text"])), entry("data.author", "required", _blank(d["author"]))),
        *of("animated-statistics", each("stats", need("label"), need("value"), hue)),
        *of("climate-timeline", each("events", year, need("title"), hue)),
        *of("climate-timeline-minimal", each("events", year, need("title"))),
        *of("climate-dashboard", each("metrics", need("title"), need("value"), ("progress", "out of range", lambda x: ~within(x["progress"], PERCENT)))),
        *of(
            "temperature-spiral",
            entry("data.startYear", "out of range", ~_zero(d["startYear"]) & ~within(d["startYear"], YEARS)),
            entry("data.endYear", "out of range", ~_zero(d["endYear"]) & ~within(d["endYear"], YEARS)),
            entry("data.endYear", "not after start", ~_zero(d["startYear"]) & ~_zero(d["endYear"]) & (d["startYear"] >= d["endYear"])),
            entry("data.rotations", "out of range", ~_zero(d["rotations"]) & ~within(d["rotations"], TURNS)),
        ),
        *of(
            "visualization",
            entry("data.type", "unknown", one_of(d["type"], VISUALS)),
            entry("data.imageCategory", "unknown", ~_blank(d["imageCategory"]) & one_of(d["imageCategory"], CATEGORIES)),
            entry("data.imageScenario", "unknown", ~_blank(d["imageScenario"]) & one_of(d["imageScenario"], SCENARIOS)),
            entry("data.imageIndicators", "unknown", F.exists(d["imageIndicators"], lambda x: one_of(x, INDICATORS))),
        ),
        *of("markdown", entry("content", "required", _blank(content))),
    ]
    return F.flatten(F.filter(F.array(*(F.coalesce(x, F.expr(_NONE)) for x in found)), lambda x: x.isNotNull()))


_NONE = "cast(array() as array<struct<field:string,rule:string>>)"

#: The payload that a new block of each type starts with; {} for others.
DEFAULTS = {
    "callout": '{"variant":"info"}',
    "interactive-callout": '{"variant":"info"}',
    "animated-quote": '{"text":"","author":"","role":""}',
    "animated-statistics": '{"stats":[{"icon":"","value":"","label":"","color":"#2d5a3d","trend":"up"}]}',
    "climate-timeline": '{"events":[{"year":2024,"title":"","description":"","type":"temperature","icon":"","color":"#2d5a3d"}]}',
    "climate-dashboard": '{"metrics":[{"title":"","value":"","change":"","trend":"up","status":"success","progress":50,"target":"","description":""}]}',
    "temperature-spiral": '{"startYear":1880,"endYear":2030,"rotations":8}',
    "visualization": '{"type":"chart","imageCategory":"risk","isOwnSource":false}',
    "climate-timeline-minimal": '{"events":[{"year":2024,"title":"","description":""}]}',
    "interactive-map": '{"selectedLayers":[],"height":"600px","centerLat":52.1326,"centerLng":5.2913,"zoom":8,"autoFitBounds":false,"enableLayerControls":true,"showLayerToggles":true,'
    '"showOpacityControls":true,"showDownloadButtons":true,"predefinedOpacities":{},"enableClusterGroups":false,"clusterGroups":[]}',
}


def default_payload(block_type: Column) -> Column:
    """JSON text."""
    table = F.create_map(*[F.lit(x) for pair in DEFAULTS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, block_type), F.lit("{}"))


def paired_insert(stories: DataFrame, blocks: DataFrame, payloads: DataFrame) -> DataFrame:
    """Q-C7: for each story (story_id) of the payloads (story_id, en, de: JSON) two new blocks at the next position, one of each language."""
    last = blocks.groupBy("story_id").agg(F.max("order_index").alias("last"))
    own = payloads.join(stories.select("story_id"), "story_id", "left_semi").join(last, "story_id", "left").withColumn("order_index", F.coalesce(F.col("last") + 1, F.lit(1)))
    rows = own.select("story_id", "order_index", F.explode(F.create_map(F.lit("en"), F.col("en"), F.lit("de"), F.col("de"))).alias("language", "data"))
    part = lambda name: F.nullif(F.get_json_object("data", f"$.{name}"), F.lit(""))
    return rows.select("story_id", F.coalesce(part("type"), F.lit("markdown")).alias("block_type"), "order_index", "data", "language", part("title").alias("title"), part("content").alias("content"))


def search(df: DataFrame, text: str, columns: list[str], arrays: list[str] = (), **equal: str) -> DataFrame:
    """Case-insensitive part of any column or array entry, and equalities that "all" switches off."""
    part = F.lit(text.lower())
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), part), F.lit(False))
    for c in arrays:
        hit = hit | F.coalesce(F.exists(c, lambda x: F.contains(F.lower(x), part)), F.lit(False))
    df = df.where(hit)
    for c, v in equal.items():
        if v != "all":
            df = df.where(F.col(c) == v)
    return df


def story_list(blocks: DataFrame, story: str, position: str) -> DataFrame:
    """Q-C4: stories with their first position and number of blocks; a story of null is one too."""
    return blocks.groupBy(F.col(story).alias("story_id")).agg(F.min(position).alias("first_turn"), F.count(F.lit(1)).alias("n_blocks"))


def blocks_of(blocks: DataFrame, kinds: list[str], kind: str, wanted: Column | None = None) -> DataFrame:
    """Q-C3, Q-C5, Q-C14: blocks of some types, in the stories that are wanted."""
    out = blocks.where(F.col(kind).isin(*kinds))
    return out if wanted is None else out.where(wanted)


def newest_first(references: DataFrame, year: str, out: str = "place") -> DataFrame:
    """Q-C2: place by year from the newest; equal years share one, and those without a year come last.

    Rows are counted by year, and only those few counts are ordered and broadcast: years have at most four digits.
    """
    years = references.groupBy(F.col(year).alias("__year")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("__year")).rowsBetween(Window.unboundedPreceding, -1))
    places = years.select("__year", (F.coalesce(before, F.lit(0)) + 1).cast("int").alias(out))
    return references.join(F.broadcast(places), F.col(year).eqNullSafe(F.col("__year"))).drop("__year")


def merged(base: DataFrame, changes: DataFrame, key: list[str], version: str = "version", deleted: str = "deleted") -> DataFrame:
    """The table after a log of changes; both have the columns of the base, among them a version and whether the row is deleted.

    Of each key the row with the highest version stays, from the base if it is as high, so a log that is applied again changes
    nothing.  Deleted rows stay as marks, or an older insert could bring them back; ``visible`` leaves them out.  Of equal
    versions in a log a delete wins, then the largest row.
    """
    names = base.columns
    both = base.withColumn("__new", F.lit(0)).unionByName(changes.select(*names).withColumn("__new", F.lit(1)))
    rank = F.struct(F.col(version), (-F.col("__new")).alias("old"), F.col(deleted), F.to_json(F.struct(*names)).alias("row"))
    return both.groupBy(*key).agg(F.max_by(F.struct(*names), rank).alias("__row")).select("__row.*")


def visible(table: DataFrame, story: str, position: str, key: list[str], deleted: str = "deleted") -> DataFrame:
    """The rows that aren't deleted, each story's positions closed to 1, 2, 3 ... in their order, ties by key."""
    own = Window.partitionBy(story).orderBy(position, *key)
    return table.where(~F.col(deleted)).withColumn(position, F.row_number().over(own)).drop(deleted)

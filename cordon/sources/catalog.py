"""Trip-file catalog: links harvested from stored pages, local files, gaps.

Every step is a DataFrame operation over a table of pages or a file listing;
nothing is fetched over the network.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cordon import params

# An attribute: a name and, behind "=", a quoted or bare value. An unclosed quote runs to the end of the page.
_ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|(?![>"'])[^\s>]++)?+)?+"""
# What may stand between a tag's name and its ">": white space, slashes and attributes.
_INSIDE = rf"(?:[\s/]++|{_ATTRIBUTE})*+"
# The pieces of a page, one after the other: comments, elements whose content is text, anchors (group 2: their inside),
# other tags, declarations. Every piece ends at the page's end at the latest and every loop is possessive, so a page is
# read once from left to right, without backtracking or recursion, however long a tag or however many quotes stay open.
_PIECES = (r"(?is)<!--(?:-?>|.*?(?:-->|\z))"
           rf"|<(script|style|title|textarea)(?=[\s/>]){_INSIDE}(?:\z|>.*?(?:</\1(?=[\s/>])|\z))"
           rf"|<a(?=[\s/])({_INSIDE})>"
           rf"|</?+[a-z][^\s/>]*+{_INSIDE}(?:>|\z)"
           r"|<[!?/][^>]*+(?:>|\z)")
_ANCHOR_GROUP = 2
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}
_REFERENCE = "(?i)&(?:#x[0-9a-f]{1,6}|#[0-9]{1,7}|lt|gt|quot|apos|amp);"


def _decoded(value: Column) -> Column:
    """Character references of an attribute value, as an HTML parser reads them, each once and in one pass."""
    named = F.create_map(*[F.lit(x) for pair in _ENTITIES.items() for x in pair])

    def put(ref):
        digits = F.regexp_extract(ref, "(?i)&#x?([0-9a-f]+);", 1)
        code = F.when(F.lower(ref).startswith("&#x"), F.conv(digits, 16, 10)).when(ref.startswith("&#"), digits).cast("long")
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.coalesce(F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), char), F.try_element_at(named, F.lower(ref)), ref)

    refs = F.regexp_extract_all(value, F.lit(_REFERENCE), 0)
    return F.array_join(F.zip_with(F.split(value, _REFERENCE, -1), F.transform(refs, put), lambda t, r: F.concat(t, F.coalesce(r, F.lit("")))), "")


def _attribute_value(attribute: Column) -> Column:
    """The unquoted, decoded value of ``name = value``."""
    raw = F.regexp_replace(attribute, r"(?s)^[^=]*=\s*", "")
    quoted = raw.startswith('"') | raw.startswith("'")
    return _decoded(F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw))


def anchor_hrefs(html: Column) -> Column:
    """Array of the ``href`` values of a page's anchors, as an HTML parser sees them.

    Comments, scripts, styles, titles and text areas hold none, nor do the attribute values of other tags; an anchor that
    the page's end cuts off is none.
    """
    tags = F.filter(F.regexp_extract_all(html, F.lit(_PIECES), _ANCHOR_GROUP), lambda t: t != "")
    attributes = F.transform(tags, lambda t: F.regexp_extract_all(t, F.lit("(?s)" + _ATTRIBUTE), 0))
    hrefs = F.transform(attributes, lambda a: F.get(F.filter(a, lambda x: x.rlike(r"(?is)^href\s*=")), 0))
    return F.transform(F.filter(hrefs, lambda h: h.isNotNull()), _attribute_value)


def _clean_href(href: Column) -> Column:
    """Drop '%20' artifacts and surrounding whitespace."""
    return F.regexp_replace(F.regexp_replace(href, "%20", ""), r"^\s+|\s+$", "")


def _is_trip_file(href: Column) -> Column:
    return (href.contains(".parquet")
            & (href.contains("yellow_tripdata") | href.contains("green_tripdata")))


def _resolve(href: Column, host: str, trip_dir: str) -> Column:
    """Absolute links as-is; root-relative under `host`; bare names under host+dir."""
    return (F.when(href.startswith("http"), href)
            .when(href.startswith("/"), F.concat(F.lit(host), href))
            .otherwise(F.concat(F.lit(host + trip_dir), href)))


def harvest_links(pages: DataFrame, trip_files_only: bool = True,
                  host: str = params.TRIP_FILE_HOST,
                  trip_dir: str = params.TRIP_FILE_DIR,
                  html_col: str = "html") -> DataFrame:
    """Distinct resolved links (column ``url``) from the anchors of every page.

    With ``trip_files_only`` the raw href must name a yellow or green
    ``.parquet`` trip file; without it every anchor is kept.
    """
    hrefs = pages.select(F.explode(anchor_hrefs(F.col(html_col))).alias("href"))
    if trip_files_only:
        hrefs = hrefs.filter(_is_trip_file(F.col("href")))
    return (hrefs.select(_resolve(_clean_href(F.col("href")), host, trip_dir).alias("url"))
            .distinct())


def parse_trip_name(name: Column) -> tuple[Column, Column, Column]:
    """(taxi_type, year, month) parsed from a file name or URL; '' type if no match."""
    clean = F.regexp_replace(name, "%20", "")
    pat = params.TRIP_FILE_PATTERN
    taxi_type = F.regexp_extract(clean, pat, 1)
    year = F.regexp_extract(clean, pat, 2)
    month = F.regexp_extract(clean, pat, 3)
    return (taxi_type,
            F.when(taxi_type != "", year.cast("int")),
            F.when(taxi_type != "", month.cast("int")))


def parse_links(links: DataFrame, url_col: str = "url") -> DataFrame:
    """Links that name a trip file -> (taxi_type, year, month, url); others dropped."""
    taxi_type, year, month = parse_trip_name(F.col(url_col))
    return (links.select(taxi_type.alias("taxi_type"), year.alias("year"),
                         month.alias("month"),
                         F.regexp_replace(F.col(url_col), "%20", "").alias("url"))
            .filter(F.col("taxi_type") != ""))


def parse_trip_path(path: Column) -> tuple[Column, Column, Column]:
    """``parse_trip_name`` of a file's path: a month is a file, or a folder of part files that bears its name."""
    return parse_trip_name(F.regexp_extract(path, r"([^/]*\.parquet)(?:/[^/]*)?$", 1))


def list_files(spark: SparkSession, directory: str, glob: str = "*") -> DataFrame:
    """File listing (path, length, modificationTime), subfolders included; file contents are never read.

    The file source plans one split per file by size even when only metadata
    is selected; coalescing (no shuffle) to the cluster's parallelism keeps a
    listing of many large files from becoming one task per file.
    """
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
            .load(directory).select("path", "length", "modificationTime")
            .coalesce(max(1, spark.sparkContext.defaultParallelism)))


def local_catalog(spark: SparkSession, directory: str) -> DataFrame:
    """Local Parquet files with parsed type, year, month and size in MB.

    Files whose names do not parse keep ``matched = false`` so they can be
    reported rather than silently read as some type. A month written as a folder
    of part files has a row for each of them.
    """
    files = list_files(spark, directory, "*.parquet")
    taxi_type, year, month = parse_trip_path(F.col("path"))
    return files.select(
        F.when(taxi_type != "", taxi_type).alias("taxi_type"),
        year.alias("year"), month.alias("month"), F.col("path"),
        (F.col("length") / F.lit(1024.0 * 1024.0)).alias("size_mb"),
        (taxi_type != "").alias("matched"))


def local_months(local: DataFrame) -> DataFrame:
    """Distinct (taxi_type, year, month) of a local catalog; files whose names do not parse are left out."""
    return local.filter("matched").select("taxi_type", "year", "month").distinct()


def available_months(parsed: DataFrame) -> DataFrame:
    """Sorted distinct months per (year, taxi_type)."""
    return (parsed.filter(F.col("taxi_type").isNotNull())
            .groupBy("year", "taxi_type")
            .agg(F.array_sort(F.collect_set("month")).alias("months")))


def missing_months(online: DataFrame, local: DataFrame, year: int) -> DataFrame:
    """Months listed online but not present locally, per type (set difference)."""
    def pick(df):
        return df.filter(F.col("year") == year).select("taxi_type", "month")
    return pick(online).subtract(pick(local))


def months_to_fetch(online: DataFrame, local: DataFrame, year: int,
                    taxi_types: Iterable[str] = params.TAXI_TYPES) -> DataFrame:
    """(taxi_type, months): the sorted months listed online but not present, per type; an empty list where none is missing."""
    types = online.sparkSession.createDataFrame([(t,) for t in taxi_types], "taxi_type string")
    months = missing_months(online, local, year).groupBy("taxi_type").agg(F.array_sort(F.collect_set("month")).alias("months"))
    return (types.join(months, "taxi_type", "left")
            .select("taxi_type", F.coalesce("months", F.array().cast("array<int>")).alias("months")))


def expected_catalog(spark: SparkSession, years: Iterable[int],
                     taxi_types: Iterable[str] = params.TAXI_TYPES,
                     months: Iterable[int] = range(1, 13)) -> DataFrame:
    """Every (year, taxi_type, month) expected, with its file name."""
    grid = (spark.range(1)
            .select(F.explode(F.array(*[F.lit(int(y)) for y in years])).alias("year"))
            .select("year", F.explode(F.array(*[F.lit(t) for t in taxi_types])).alias("taxi_type"))
            .select("year", "taxi_type",
                    F.explode(F.array(*[F.lit(int(m)) for m in months])).alias("month")))
    return grid.withColumn("file_name", F.format_string(
        params.TRIP_FILE_FORMAT, F.col("taxi_type"), F.col("year"), F.col("month")))


def missing_from_expected(expected: DataFrame, available: DataFrame) -> DataFrame:
    """Expected (year, taxi_type, month) with no available file."""
    keys = ["year", "taxi_type", "month"]
    have = available.select(*keys).filter(
        F.col("year").isNotNull() & F.col("taxi_type").isNotNull() & F.col("month").isNotNull())
    return expected.join(have, keys, "left_anti")


def needs_imputation(missing: DataFrame, month: int = 12) -> DataFrame:
    """One row: is `month` missing for either taxi type?"""
    return missing.agg((F.count_if(F.col("month") == month) > 0).alias("needs_imputation"))


def imputation_gate(available: DataFrame, years: Iterable[int], month: int = 12,
                    taxi_types: Iterable[str] = params.TAXI_TYPES) -> DataFrame:
    """Per year: the taxi types whose `month` is not available, and whether it has to be imputed (any type lacks it)."""
    grid = expected_catalog(available.sparkSession, years, taxi_types, [month])
    have = available.select("year", "taxi_type", "month").distinct().withColumn("_there", F.lit(True))
    lacks = F.when(F.col("_there").isNull(), F.col("taxi_type"))
    return (grid.join(have, ["year", "taxi_type", "month"], "left").groupBy("year")
            .agg(F.array_sort(F.collect_set(lacks)).alias("missing_types"), (F.count(lacks) > 0).alias("needs_imputation")))


def fetch_plan(online: DataFrame, local: DataFrame, years: Iterable[int],
               comparison_years: Iterable[int] = ()) -> DataFrame:
    """Listed trip files of the wanted years that are not present locally.

    The wanted years are the distinct union of analysis and comparison
    years; a file already present (same type, year, month) is skipped.
    """
    wanted = sorted(set(int(y) for y in years) | set(int(y) for y in comparison_years))
    keys = ["taxi_type", "year", "month"]
    have = local.filter(F.col("taxi_type").isNotNull()).select(*keys)
    name = F.format_string(params.TRIP_FILE_FORMAT, F.col("taxi_type"), F.col("year"), F.col("month"))
    # The download address is built from the file name, not taken from a scraped link.
    return (online.filter(F.col("year").isin(wanted)).select(*keys).distinct()
            .join(have, keys, "left_anti")
            .withColumn("file_name", name)
            .withColumn("url", F.concat(F.lit(params.TRIP_FILE_HOST + params.TRIP_FILE_DIR), name)))

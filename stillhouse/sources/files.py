"""Folders of text, JSON and table files as DataFrames, and the ways back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Endings that are read as documents.
SUFFIXES = ("txt", "md", "json", "jsonl")


def scan_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, suffix, modified, content) of all files below ``root`` with one of the endings, any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.select("path", suffix.alias("suffix"), F.col("modificationTime").alias("modified"), "content").filter(F.col("suffix").isin(*suffixes))


def load_documents(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents: source, section, text), (failures: source, error) of scanned files.

    txt and md: one document a file. json: an object is one document (its text field, or itself as JSON), a list one per
    object with section item_i, a scalar its text; broken JSON is a failure. jsonl: one per line that isn't blank,
    section line_i counting all lines; a broken line is its own text. Undecodable bytes become replacement
    characters; blank documents are left out; nothing stops the run.
    """
    body = files.select(F.col("path").alias("source"), "suffix", F.make_valid_utf8(F.col("content").cast("string")).alias("body"))
    field = lambda c: F.coalesce(F.get_json_object(c, "$.text"), c)
    plain = body.filter(F.col("suffix").isin("txt", "md")).select("source", F.lit(None).cast("string").alias("section"), F.col("body").alias("text"))
    parsed = body.filter("suffix = 'json'").withColumn("ok", F.expr("try_parse_json(body) is not null"))
    good = parsed.filter("ok").withColumn("b", F.trim("body"))
    lists = good.filter("b like '[%'").select("source", F.posexplode(F.from_json("b", "array<string>")).alias("i", "x")).filter("trim(x) like '{%'").select("source", F.concat(F.lit("item_"), "i").alias("section"), field(F.col("x")).alias("text"))
    single = good.filter("b not like '[%'").select("source", F.lit(None).cast("string").alias("section"), F.when(F.col("b").startswith("{"), field(F.col("b"))).otherwise(F.get_json_object("b", "$")).alias("text"))
    lines = body.filter("suffix = 'jsonl'").select("source", F.posexplode(F.split("body", r"\r?\n")).alias("i", "x")).filter(F.col("x").rlike(r"\S"))
    rows = lines.select("source", F.concat(F.lit("line_"), "i").alias("section"), F.when(F.expr("try_parse_json(x) is not null") & F.trim("x").startswith("{"), field(F.col("x"))).otherwise(F.col("x")).alias("text"))
    documents = plain.unionByName(single).unionByName(lists).unionByName(rows).filter(F.col("text").rlike(r"\S"))
    failures = parsed.filter("not ok").select("source", F.lit("broken JSON").alias("error"))
    return documents, failures


def plain_path(path: Column) -> Column:
    """A path as the key of a source: trimmed, in small letters, with single forward slashes and none at the end."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(path)), r"[/\\\\]+", "/"), r"(?<=.)/$", "")


def registered_sources(registry: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents below an enabled root of the registry (name, path, enabled, hint), with its name and hint.

    Every folder above a document is looked up as a root by equality, so a registry of any size will do; the longest root
    wins, then the smaller name. Repeated documents stay. Roots are whole folders or files: a root isn't found inside a name.
    """
    r = registry.filter("enabled and path is not null").groupBy(plain_path(F.col("path")).alias("root")).agg(F.min(F.struct(F.col("name").alias("registered"), "hint")).alias("r"))
    parts = F.split(plain_path(F.col("source")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    paths = documents.select("source").distinct()
    hits = paths.select("source", F.explode(above).alias("root")).join(r, "root")
    best = hits.groupBy("source").agg(F.max_by("r", F.length("root")).alias("r"))
    return documents.join(best, "source").select("source", "section", "text", F.col("r.registered").alias("registered"), F.col("r.hint").alias("hint"))


def upsert_sources(registry: DataFrame, new: DataFrame) -> DataFrame:
    """(path, name, hint, change) of a registry after ``new`` sources (path, name, hint) are put in, matched by plain path.

    What is stated anew wins, what is missing there stays; change is added, updated or kept. Of several rows of a path the
    smallest values count; a null path is no source.
    """
    one = lambda df: df.filter("path is not null").groupBy(plain_path(F.col("path")).alias("path")).agg(F.min("name").alias("name"), F.min("hint").alias("hint"))
    o, n = one(registry).alias("o"), one(new).alias("n")
    change = F.when(F.col("o.path").isNull(), "added").when(F.col("n.path").isNull(), "kept").otherwise("updated")
    both = o.join(n, F.col("o.path") == F.col("n.path"), "full_outer")
    return both.select(F.coalesce("n.path", "o.path").alias("path"), F.coalesce("n.name", "o.name").alias("name"), F.coalesce("n.hint", "o.hint").alias("hint"), change.alias("change"))


def load_tei(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents: source, title, journal, doi, year, authors, abstract), (sections: source, no, text) of scanned TEI files.

    Tags are read by their local names. Files that aren't XML give no row. A section is a division of the body that has
    text; its paragraphs are joined by blanks.
    """
    x = files.select(F.col("path").alias("source"), F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), r'\sxmlns(:\w+)?="[^"]*"', "").alias("b")).filter(F.ltrim("b").startswith("<"))
    one = lambda path: F.nullif(F.trim(F.regexp_replace(F.xpath_string("b", F.lit(path)), r"\s+", " ")), F.lit(""))
    dates = F.concat_ws(" ", F.xpath("b", F.lit("//publicationStmt/date/@when")), F.xpath("b", F.lit("//publicationStmt/date/text()")), F.xpath("b", F.lit("//imprint/date/@when")), F.xpath("b", F.lit("//imprint/date/text()")))
    surname, first = F.xpath("b", F.lit("//sourceDesc//author//surname/text()")), F.xpath("b", F.lit("//sourceDesc//author//forename/text()"))
    names = F.when(F.size(surname) == F.size(first), F.zip_with(first, surname, lambda f, s: F.concat_ws(" ", f, s))).otherwise(surname)
    doi = F.coalesce(one("//idno[@type='DOI']"), one("//idno[@type='doi']"))
    documents = x.select("source", one("//titleStmt/title").alias("title"), one("//monogr/title").alias("journal"), doi.alias("doi"), F.regexp_extract(dates, r"((?:19|20)\d{2})", 1).try_cast("int").alias("year"), F.array_distinct(names).alias("authors"), one("//profileDesc/abstract").alias("abstract"))
    count = F.xpath_int("b", F.lit("count(//body/div)"))
    divisions = x.select("source", "b", F.explode(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))).alias("no"))
    # one path per place: the path must be a constant, so places up to the longest file's number of divisions are asked for
    most = divisions.agg(F.coalesce(F.max("no"), F.lit(0))).first()[0]
    text = F.lit(None).cast("string")
    for i in range(1, most + 1):
        text = F.when(F.col("no") == i, F.array_join(F.xpath("b", F.lit(f"//body/div[{i}]//p//text()")), " ")).otherwise(text)
    sections = divisions.select("source", "no", F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text")).filter("text <> ''")
    return documents, sections


def hash_import(files: DataFrame) -> DataFrame:
    """(path, sha, first_path, copy): every file with the first path (in order) of its content; copies are marked."""
    rows = files.select("path", F.sha2("content", 256).alias("sha"))
    first = rows.groupBy("sha").agg(F.min("path").alias("first_path"))
    return rows.join(first, "sha").select("path", "sha", "first_path", (F.col("path") != F.col("first_path")).alias("copy"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; a byte-order mark before the first name is taken off."""
    df = spark.read.option("header", "true").option("inferSchema", "true").csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str, by: str | None = None) -> None:
    """Append rows as JSON lines, parted by a column if given."""
    w = df.write.mode("append")
    (w.partitionBy(by) if by else w).json(path)

"""Contact files with unknown layout as DataFrames.

Files are read line by line with splittable scans, so one huge file is many
tasks.  Everything decided per file (header row, column mapping, social or
plain, encoding) comes from its first ten lines or from a small aggregate, and
is joined back to the lines by file.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom import dictionaries as D
from leadloom.functions import text as T
from leadloom.operators.common import computed_once, join_dimension

CANONICAL = [*D.HEADER_WORDS, "first_name", "last_name"]


def file_listing(spark: SparkSession, path: str, extensions: list[str] | None = None) -> DataFrame:
    """path, name, size and time of the data files below a folder, sorted; contents are not read."""
    extensions = extensions or D.DATA_EXTENSIONS
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select("path", "length", "modificationTime"))
    return (files.filter(F.lower("path").rlike(r"\.(" + "|".join(extensions) + ")$"))
            .withColumn("file_name", F.element_at(F.split("path", "/"), -1)).orderBy("path"))


#: A cell of delimited text; in quotes it may hold commas and line breaks.
CELL = r',("[^"]*+(?:""[^"]*+)*+"|[^,]*+)'
_WHOLE = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+)?+'
_INSIDE = r'[^"]*+(?:""[^"]*+)*+'
#: A line that begins between records and ends inside a quoted cell, and a line inside a cell that closes it and ends inside another.
OPENS = rf'^(?:{_WHOLE},)*+"{_INSIDE}\z'
STAYS = rf'^{_INSIDE}(?:"[^,]*+,(?:{_WHOLE},)*+"{_INSIDE})?+\z'


def read_lines(spark: SparkSession, path: str, quoted: bool = False) -> DataFrame:
    """file, at (place in the file), modified (date) and text of every line, or with ``quoted`` of every record.

    Lines are read by splittable scans; files that are not valid UTF-8 are
    latin-1.  Records may hold line breaks in quoted cells, across splits too
    (``stitched``).  Files in UTF-16 are read as a whole; which files these are is
    one small job.  ``at`` orders the lines of a file across its splits.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"),
        F.col("_metadata.file_modification_time").cast("date").alias("modified"), "value")
    odd = F.hex(F.substring(F.col("value").cast("binary"), 1, 2)).isin("FFFE", "FEFF")
    whole = [r[0] for r in raw.filter(odd).select("file").distinct().collect()]  # names of the UTF-16 files only
    lines = raw.filter(~F.col("file").isin(whole)) if whole else raw
    checked = lines.withColumn("_utf8", F.try_validate_utf8("value"))
    foreign = checked.filter(F.col("_utf8").isNull()).select("file").distinct().withColumn("_latin", F.lit(True))
    out = join_dimension(checked, foreign, "file", ["at"]).select(
        "file", "at", "modified", F.regexp_replace(F.when(F.col("_latin"), F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
                                                   .otherwise(F.col("_utf8")), "^\ufeff|\r$", "").alias("text"))
    if whole:
        files = spark.read.format("binaryFile").load(whole).select(
            F.col("_metadata.file_path").alias("file"), F.col("modificationTime").cast("date").alias("modified"),
            F.regexp_replace(decode_content(F.col("content")), "^\ufeff", "").alias("_all"))
        parts = files.select("file", "modified", F.posexplode(F.regexp_extract_all("_all", F.lit(r"([^\r\n]++)"), F.lit(1))).alias("_pos", "text"))
        out = out.unionByName(parts.select("file", F.struct(F.lit(0).cast("bigint").alias("block"), F.col("_pos").cast("bigint").alias("row")).alias("at"),
                                           "modified", "text"))
    return stitched(out) if quoted else out


def stitched(lines: DataFrame) -> DataFrame:
    """Lines with those that belong to one record joined by line feeds, each record at the place of its first line.

    Whether a line begins inside a quoted cell follows from all lines before it:
    each line maps the state it begins in to the state it ends in, and these maps
    are composed, first within every split, then over the splits of a file (one
    row per split), so that a file of any size stays many tasks.  A record that
    reaches over a split is carried to the split it began in.  Files without a line
    that leaves a cell open are not touched.  A quote that is never closed
    is an ordinary character: the lines after it are records of their own.
    """
    has = F.col("text").contains('"')
    begun = F.when(has, F.col("text").rlike(OPENS)).otherwise(F.lit(False))
    flagged = computed_once(lines, {"_0": begun})
    files = flagged.filter("_0").select("file").distinct().withColumn("_open", F.lit(True))
    flagged = join_dimension(flagged, files, "file", ["at"])
    plain = flagged.filter(F.col("_open").isNull()).select("file", "at", "modified", "text")
    odd = flagged.filter("_open").select("file", "at", "modified", "text", F.col("at.block").alias("_block"), "_0",
                                         F.when(has, F.col("text").rlike(STAYS)).otherwise(F.lit(True)).alias("_1"))
    split = Window.partitionBy("file", "_block").orderBy("at")
    constant, swap = F.when(F.col("_0") == F.col("_1"), F.col("_0").cast("int")), (F.col("_0") & ~F.col("_1")).cast("int")
    odd = odd.withColumn("_total", F.sum(swap).over(split.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    mark = F.when(constant.isNotNull(), F.struct(constant.alias("v"), F.col("_total").alias("t")))
    odd = odd.withColumns({
        "_past": F.last(mark, ignorenulls=True).over(split.rowsBetween(Window.unboundedPreceding, -1)),
        "_now": F.last(mark, ignorenulls=True).over(split.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    flips = F.col("_total") - swap  # before the line
    known = F.when(F.col("_past").isNotNull(), (F.col("_past.v") + flips - F.col("_past.t")) % 2)

    ends = odd.groupBy("file", "_block").agg(F.max_by(F.struct("_total", "_now"), "at").alias("e"))
    ends = ends.select("file", "_block", F.when(F.col("e._now").isNotNull(), (F.col("e._now.v") + F.col("e._total") - F.col("e._now.t")) % 2).alias("_end"),
                       F.when(F.col("e._now").isNull(), F.col("e._total") % 2).otherwise(0).alias("_flip"))
    order = Window.partitionBy("file").orderBy("_block")  # one row per split
    ends = ends.withColumn("_sum", F.sum("_flip").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    kept = F.when(F.col("_end").isNotNull(), F.struct(F.col("_end").alias("v"), F.col("_sum").alias("t")))
    ends = ends.withColumn("_past", F.last(kept, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    before = F.col("_sum") - F.col("_flip")
    ends = ends.select("file", "_block", "_end", "_flip", (F.when(F.col("_past").isNotNull(), F.col("_past.v") + before - F.col("_past.t")).otherwise(before) % 2).alias("_begin"))
    left = ends.groupBy("file").agg(F.max_by(F.coalesce("_end", (F.col("_begin") + F.col("_flip")) % 2), "_block").alias("_left"))

    rows = odd.withColumns({"_known": known, "_flips": flips}).join(ends.select("file", "_block", "_begin"), ["file", "_block"])
    rows = rows.withColumn("_state", F.coalesce("_known", (F.col("_flips") + F.col("_begin")) % 2))
    first = F.when(F.col("_state") == 0, F.col("at"))
    rows = rows.withColumn("_start", F.last(first, ignorenulls=True).over(split.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    lasts = rows.groupBy("file", "_block").agg(F.max(first).alias("_last"))
    carried = lasts.select("file", "_block", F.last("_last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    open_ends = lasts.groupBy("file").agg(F.max("_last").alias("_final")).join(left.filter("_left = 1"), "file")
    rows = rows.join(carried, ["file", "_block"]).withColumn("_start", F.coalesce("_start", "_carry")).join(open_ends, "file", "left")
    ended = F.when(F.col("_state") == 0, F.col("_0")).otherwise(F.col("_1"))
    alone = ((F.col("_state") == 0) & ~ended) | F.coalesce(F.col("_start") == F.col("_final"), F.lit(False))
    parts = rows.filter(~alone).groupBy("file", "_start").agg(
        F.min("modified").alias("modified"), F.array_sort(F.collect_list(F.struct("at", "text"))).alias("t"))
    joined = parts.select("file", F.col("_start").alias("at"), "modified", F.array_join(F.col("t.text"), "\n").alias("text"))
    return plain.unionByName(rows.filter(alone).select("file", "at", "modified", "text")).unionByName(joined)


def head_lines(lines: DataFrame, n: int = 10) -> DataFrame:
    """The first n lines of every file, numbered; only first splits are ranked."""
    order = Window.partitionBy("file").orderBy("at")
    return (lines.filter("at.block = 0").withColumn("line_no", F.row_number().over(order))
            .filter(F.col("line_no") <= n))


def decode_content(content: Column) -> Column:
    """Text of whole small files: BOM, else valid UTF-8, else latin-1."""
    start = F.hex(F.substring(content, 1, 3))
    return (F.when(start.startswith("FFFE") | start.startswith("FEFF"), F.decode(content, "UTF-16"))
            .when(start == "EFBBBF", F.decode(F.substring(content, 4, 2**31 - 1), "UTF-8"))
            .otherwise(F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Phones of documents that are no tables, one row each.

    A phone never holds a line break, so documents of any size and kind are
    scanned in splits by their line breaks, as bytes; a match cannot lie on a seam.
    """
    chunks = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").cast("date").alias("modified"),
                 F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("f"), F.col("value").alias("content"))
    found = phones_in_content(chunks, "f")
    lines = found.select("f.*", "pos", "phone")
    # numbered anew where found, so that each phone has a place of its own
    return lines.select("file", F.struct("block", F.monotonically_increasing_id().alias("row")).alias("at"), "modified", F.col("phone").alias("raw_phone"))


def phones_in_content(files: DataFrame, key: str) -> DataFrame:
    """Phone-like texts in the raw bytes of documents that are no tables."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(r"((?:0|\+84)[0-9]{8,10})"), F.lit(1))).alias("pos", "phone"))


# --- delimited files -------------------------------------------------------
def _cells(record: Column) -> Column:
    """All cells of a record, parsed once; an empty cell without quotes is null."""
    found = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(CELL), F.lit(1))
    inside = lambda x: F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
    return F.transform(found, lambda x: F.when(x.startswith('"') & x.endswith('"') & (F.length(x) > 1), inside(x)).otherwise(F.nullif(x, F.lit(""))))


def header_hits(line: Column) -> Column:
    """Number of canonical columns with a keyword in the line."""
    low = F.lower(line)
    return sum((low.rlike("|".join(words)).cast("int") for words in D.HEADER_WORDS.values()), F.lit(0))


def detect_headers(lines: DataFrame) -> DataFrame:
    """Per file the line with most keyword families (the first of the best), its place and cells."""
    scored = head_lines(lines.filter("trim(text) <> ''")).withColumn("_hits", header_hits(F.col("text")))
    best = scored.groupBy("file").agg(F.max_by(F.struct("at", "text"), F.struct("_hits", (-F.col("line_no")).alias("n"))).alias("h"))
    return best.select("file", F.col("h.at").alias("header_at"), _cells(F.col("h.text")).alias("cells"))


def _first_index(cells: Column, used: Column, pattern: str) -> Column:
    """Index of the first unused header that matches, or null."""
    free = F.filter(F.sequence(F.lit(0), F.size(cells) - 1), lambda i: ~F.array_contains(used, i) & F.coalesce(
        F.get(cells, i).rlike(pattern), F.lit(False)))
    return F.get(free, F.lit(0))


def map_columns(headers: DataFrame, words: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds ``i_<column>``: the header index of each canonical column, each header used once."""
    words = words or D.HEADER_WORDS
    rows = headers.withColumn("_low", F.transform("cells", lambda h: F.lower(F.trim(h)))).withColumn(
        "_used", F.array().cast("array<int>"))
    for name, keywords in words.items():
        rows = rows.withColumn(f"i_{name}", _first_index(F.col("_low"), F.col("_used"), "|".join(keywords)))
        rows = rows.withColumn("_used", F.when(F.col(f"i_{name}").isNotNull(),
                                               F.concat("_used", F.array(f"i_{name}"))).otherwise(F.col("_used")))
    nothing = F.array().cast("array<int>")
    unnamed = F.col("i_name").isNull()
    return rows.withColumns({
        f"i_{part}_name": F.when(unnamed, _first_index(F.col("_low"), nothing, f"{part} name")) for part in ("first", "last")
    }).drop("_low", "_used")


def read_contact_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of delimited contact files in canonical raw columns, for any number of columns."""
    lines = read_lines(spark, path, quoted=True)
    mapping = map_columns(detect_headers(lines)).drop("cells")
    data = join_dimension(lines, mapping, "file", ["at"], "inner").filter((F.col("at") > F.col("header_at")) & (F.trim("text") != ""))
    data = computed_once(data, {"_c": _cells(F.col("text"))})

    def cell(name):
        return F.get("_c", F.col(f"i_{name}"))

    return data.select(
        "file", "at", "modified", T.name_compose(cell("name"), cell("first_name"), cell("last_name")).alias("raw_name"),
        *[cell(src).alias(dst) for src, dst in (
            ("phone", "raw_phone"), ("email", "raw_email"), ("address", "raw_address"), ("source", "raw_source"),
            ("campaign", "raw_campaign"), ("date", "raw_date"), ("note", "raw_note"), ("fb_uid", "raw_uid"), ("fb_link", "raw_link"))])


def identity_columns(headers: DataFrame) -> DataFrame:
    """First header index for uid, name and phone; headers may serve twice."""
    low = F.transform("cells", lambda h: F.lower(h))
    nothing = F.array().cast("array<int>")
    return headers.withColumn("_low", low).withColumns({
        f"i_{k}": _first_index(F.col("_low"), nothing, "|".join(w)) for k, w in (
            ("uid", D.IDENTITY_UID_WORDS), ("name", D.IDENTITY_NAME_WORDS), ("phone", D.IDENTITY_PHONE_WORDS))}).drop("_low")


def read_identities(lines: DataFrame) -> DataFrame:
    """uid, name and phone of the rows of identity files, by their own header words."""
    heads = identity_columns(detect_headers(lines)).drop("cells")
    data = join_dimension(lines, heads, "file", ["at"], "inner").filter((F.col("at") > F.col("header_at")) & (F.trim("text") != ""))
    data = computed_once(data, {"_c": _cells(F.col("text"))})
    cell = lambda name: T.blank_to_null(F.get("_c", F.col(f"i_{name}")))
    return data.select("file", "at", "modified", *[cell(n).alias(n) for n in ("uid", "name", "phone")])


# --- text files ------------------------------------------------------------
def read_phone_list(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path).select("file", "at", "modified", F.trim("text").alias("raw_phone")).filter("raw_phone <> ''")


def social_files(lines: DataFrame) -> DataFrame:
    """Files whose head names facebook.com or that start with a long number and more text.

    A long number alone on its line is a phone list, not a social export.
    """
    head = head_lines(lines.filter("trim(text) <> ''"))
    return head.groupBy("file").agg(F.bool_or(
        F.lower("text").contains("facebook.com") | ((F.col("line_no") == 1) & F.trim("text").rlike(r"^[0-9]{9,}\s+\S"))).alias("is_social"))


def parse_social(lines: DataFrame) -> DataFrame:
    """uid, phone, e-mail and name from free-order tokens of a line."""
    rows = lines.withColumn("_p", F.split(F.trim("text"), r"\s+")).filter(F.size("_p") >= 2)
    first = F.get("_p", F.lit(0))

    def find(test):
        return F.coalesce(F.get(F.filter("_p", test), F.lit(0)), F.lit(""))

    rows = rows.withColumns({
        "uid": F.coalesce(F.nullif(find(lambda t: t.rlike("^[0-9]{14,}$")), F.lit("")),
                          F.when(first.rlike("^[0-9]{9,}$"), first), F.lit("")),
        "phone": find(lambda t: t.startswith("+84") | t.rlike("^0[0-9]{9,}$")),
        "email": find(lambda t: t.contains("@"))})
    known = F.array("uid", "phone", "email", *[F.lit(w) for w in D.LOCALE_WORDS])
    names = F.filter("_p", lambda t: ~F.array_contains(known, t) & ~F.lower(t).startswith("http") & ~t.rlike("^[0-9]+$"))
    return rows.withColumn("name", F.array_join(F.slice(names, 1, 3), " ")).withColumn(
        "link", F.when(F.col("uid") != "", F.concat(F.lit("https://facebook.com/"), "uid")).otherwise("")).drop("_p")


def read_social_txt(spark: SparkSession, path: str) -> DataFrame:
    return social_rows(read_lines(spark, path))


def social_rows(lines: DataFrame) -> DataFrame:
    """Parsed lines of the text files that are social exports."""
    social = social_files(lines).filter("is_social")
    return parse_social(join_dimension(lines, social, "file", ["at"], "inner").drop("is_social"))


def plain_phone_files(lines: DataFrame) -> DataFrame:
    """Lines of the text files that are not social exports, one phone each."""
    flagged = join_dimension(lines, social_files(lines), "file", ["at"])
    return (flagged.filter(~F.coalesce("is_social", F.lit(False))).select("file", "at", "modified", F.trim("text").alias("raw_phone"))
            .filter("raw_phone <> ''"))

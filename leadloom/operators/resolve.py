"""Contact resolution: cleaning, first-seen leads, rejects, golden records.

Keys may be very unevenly spread, so nothing here sorts or collects the rows
of one key: first-seen is an aggregate joined back on (key, file, position),
and the merge is built from aggregates with map-side combine.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import dictionaries as D
from leadloom.functions import phones as P
from leadloom.functions import text as T
from leadloom.operators.common import computed_once, join_dimension
from leadloom.session import staged

STATUSES = ("valid", "duplicate", "missing_contact", "invalid_phone")

#: Columns of keyed rows that golden contacts and their files are made of.
MERGED = ("lead_key", "reject", "phone", "email", "name", "uid", "link", "address", "file_name", "pos", "file_date", "raw_note", "raw_source")


#: Bits of a word, and the most files that golden contacts count by bits.
FILE_BITS, COUNTED_FILES = 63, 8 * 63


def clean(raw: DataFrame) -> DataFrame:
    """Cleaned columns next to the raw ones; one row per input row."""
    once = computed_once(raw, {
        "_body": P.mobile_body(F.col("raw_phone")), "email": T.email_clean(F.col("raw_email"))})
    return once.withColumns({
        "e164": F.concat(F.lit("+84"), F.col("_body")),
        "phone": F.concat(F.lit("0"), F.col("_body")),
        "name": T.name_clean(F.col("raw_name")),
        "address": F.coalesce(T.blank_to_null(F.col("raw_address")), F.lit("")),
        "uid": F.coalesce(T.blank_to_null(F.col("raw_uid")), F.lit("")),
        "link": F.coalesce(T.blank_to_null(F.col("raw_link")), F.lit("")),
    }).drop("_body")


def lead_keys(cleaned: DataFrame) -> DataFrame:
    """Adds ``lead_key`` (phone; the e-mail of rows without a phone text) and ``reject``.

    The key is null for rejected rows: an invalid phone text, or no contact at all.
    """
    has_phone = F.coalesce(F.trim("raw_phone").rlike("(?i)^(?!nan$).+"), F.lit(False))
    key = F.coalesce(F.col("phone"), F.when(~has_phone, F.col("email")))
    reject = F.when(F.col("phone").isNotNull(), None).when(has_phone, "invalid_phone").when(
        F.col("email").isNull(), "missing_contact")
    return cleaned.withColumns({"lead_key": key, "reject": reject})


def history_keys(contacts: DataFrame) -> DataFrame:
    """Distinct phones and e-mails already stored."""
    return (contacts.select(F.explode(F.array("phone", "email")).alias("lead_key"))
            .filter(F.coalesce(F.col("lead_key"), F.lit("")) != "").distinct())


def unseen(keyed: DataFrame, history: DataFrame, row: list[str]) -> DataFrame:
    """Rows whose key is not in the history (distinct keys)."""
    return join_dimension(keyed, history.select("lead_key"), "lead_key", row, "left_anti")


def already_seen(keyed: DataFrame, history: DataFrame) -> DataFrame:
    return keyed.join(history.select("lead_key"), "lead_key", "left_semi")


def mark_status(keyed: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Adds ``status``: the first row of a key in file order is the lead.

    The first (file, position) of each key comes from an aggregate; joining it
    back on key, file and position spreads a hot key over all partitions.
    """
    candidates = keyed.filter("lead_key IS NOT NULL").select("lead_key", "file_name", "pos")
    firsts = candidates.groupBy("lead_key").agg(F.min(F.struct("file_name", "pos")).alias("first"))
    if history is not None:
        firsts = firsts.join(history.select("lead_key"), "lead_key", "left_anti")
    firsts = (firsts.select("lead_key", "first.file_name", "first.pos", F.lit(True).alias("is_first")))
    return (
        keyed.join(firsts, ["lead_key", "file_name", "pos"], "left")
        .withColumn("status", F.coalesce("reject", F.when(F.col("is_first"), "valid").otherwise("duplicate")))
        .drop("is_first")
    )


def rejects(marked: DataFrame) -> DataFrame:
    """Rejected rows with the reason text of the export."""
    reason = (F.when(F.col("status") == "missing_contact", D.REASON_MISSING)
              .when(F.col("status") == "invalid_phone",
                    F.concat(F.lit(D.REASON_INVALID_PHONE), F.col("raw_phone")))
              .otherwise(D.REASON_DUPLICATE))
    return marked.filter("status <> 'valid'").select(
        "raw_name", "raw_phone", "raw_email", "raw_uid", "raw_link", reason.alias("reason"),
        F.col("file_name").alias("file_origin"), "pos")


def new_leads(marked: DataFrame) -> DataFrame:
    """Accepted rows in the canonical layout."""
    valid = T.with_province(marked.filter("status = 'valid'"), F.col("address"), F.col("file_name"))
    return valid.select(
        "name", "phone", "email", "address", "province",
        F.coalesce(T.blank_to_null(F.col("raw_source")),
                   T.source_from_content(F.col("raw_name"), F.col("raw_email"), F.col("raw_address"),
                                         F.col("raw_note"), F.col("raw_link"), F.col("file_name"))
                   ).alias("source"),
        F.coalesce("raw_campaign", F.lit("")).alias("campaign"),
        F.coalesce("raw_note", F.lit("")).alias("note"),
        F.col("file_name").alias("file_origin"), "uid", "link", "lead_key", "pos")


def ingest_stats(marked: DataFrame) -> DataFrame:
    """Counts per file, and the total in the row without a file."""
    per_file = T.with_province(marked, F.col("address"), F.col("file_name")).groupBy("file_name").agg(
        F.count("*").alias("total_rows"),
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
        F.count_if((F.col("status") == "valid") & (F.col("province") == "Unknown")).alias("unclassified"))
    sums = ["total_rows", *STATUSES, "unclassified"]
    return per_file.rollup("file_name").agg(*[F.sum(c).alias(c) for c in sums])


def file_tiers(files: DataFrame) -> DataFrame:
    """Tier and weight of every file name, as a written table: its real size decides how it is joined, so that
    few files are sent to the rows and the rows are not moved to them."""
    tiers = T.classify_files(files.select("file_name").distinct()).select(
        "file_name", F.col("tier").alias("source_tier"), F.col("weight").alias("source_weight"))
    return staged(tiers, "tiers")


def with_tier(rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Tier and weight of each row's file, classified once per file."""
    return join_dimension(rows, file_tiers(rows if files is None else files), "file_name", ["file_name", "pos"])


def golden(keyed: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One contact per key.

    Rows of a phone are merged: first non-empty value by file order, the best
    tier, the longest address, the number of distinct files.  E-mail-only
    contacts keep their first row.

    ``files`` names all files of the rows.  Up to ``COUNTED_FILES`` of them are
    numbered in the order of their names: rows are merged per key at once, a
    number stands for the file, and a contact's files are the bits of a few
    words.  Of more files, rows are merged per key and file first, and these
    then per key.
    """
    alone = F.col("phone").isNull()
    filled = ("email", "name", "uid", "link")
    tiers = file_tiers(keyed if files is None else files)
    named = sorted((tuple(r) for r in tiers.filter("file_name IS NOT NULL").limit(COUNTED_FILES + 1).collect()))
    rows = keyed.filter("lead_key IS NOT NULL")

    def first(cond: Column | None, *cells) -> Column:
        """The least struct: the value of its last fields in the order of its first ones."""
        return F.min(F.struct(*cells) if cond is None else F.when(cond, F.struct(*cells)))

    def cells(at: str) -> list[Column]:
        values = {name: F.coalesce(F.col(name), F.lit("")) for name in filled}
        widest = F.when(alone, 0).otherwise(-F.length("address"))
        return [F.max("phone").alias("phone"), *[first((v != "") | alone, at, "pos", v.alias("v")).alias(name) for name, v in values.items()],
                first(None, widest.alias("n"), at, "pos", F.col("address").alias("v")).alias("address"),
                first(None, at, "pos", "raw_note", "raw_source").alias("head"),
                first(None, at).alias("file"), F.max("file_date").alias("latest_file_date")]

    best = F.when(alone, 0.0).otherwise(-F.col("source_weight")).alias("w")
    if len(named) <= COUNTED_FILES:
        at, words = "_file", range(0, max(len(named), 1), FILE_BITS)
        numbers = pa.table({"file_name": pa.array([n for n, _, _ in named], pa.string()), at: pa.array(range(len(named)), pa.int32()),
                            "source_weight": pa.array([w for _, _, w in named], pa.float64())})
        listed = rows.join(F.broadcast(keyed.sparkSession.createDataFrame(numbers)), "file_name", "left")
        seen = [F.bit_or(F.when(F.col(at).between(w, w + FILE_BITS - 1), F.expr(f"shiftleft(1L, {at} - {w})"))) for w in words]
        merged = listed.groupBy("lead_key").agg(*cells(at), first(None, best, at).alias("best"), *[bits.alias(f"_seen{i}") for i, bits in enumerate(seen)])
        n_files = sum((F.coalesce(F.bit_count(f"_seen{i}"), F.lit(0)) for i in range(1, len(seen))), F.coalesce(F.bit_count("_seen0"), F.lit(0))).cast("bigint")

        def listed_as(i: int, number: str) -> Column:
            return F.get(F.array(*[F.lit(f[i]) for f in named]), F.col(number)) if named else F.lit(None)

        file_source, tier, weight = listed_as(0, f"file.{at}"), listed_as(1, f"best.{at}"), listed_as(2, f"best.{at}")
    else:
        at = "file_name"
        per_file = rows.groupBy("lead_key", at).agg(*cells(at))
        merged = join_dimension(per_file, tiers, at, ["lead_key"]).groupBy("lead_key").agg(
            *[F.max(x).alias(x) for x in ("phone", "latest_file_date")], *[F.min(x).alias(x) for x in (*filled, "address", "head", "file")],
            first(None, best, at, "source_tier", "source_weight").alias("best"), F.count(at).alias("n_files"))
        n_files, file_source, tier, weight = (F.col(x) for x in ("n_files", f"file.{at}", "best.source_tier", "best.source_weight"))
    return merged.select(
        "lead_key", "phone", *[F.coalesce(F.col(name)["v"], F.lit("")).alias(name) for name in filled],
        F.col("address")["v"].alias("address"),
        tier.cast("string").alias("source_tier"),
        weight.cast("double").alias("source_weight"),
        F.when(F.col("phone").isNull(), F.lit(1).cast("bigint")).otherwise(n_files).alias("source_count"),
        "latest_file_date", file_source.cast("string").alias("file_source"),
        F.coalesce("head.raw_note", F.lit("")).alias("note"),
        F.coalesce("head.raw_source", F.lit("")).alias("source"))


def golden_names(keyed: DataFrame) -> DataFrame:
    """Every distinct name of a contact, one row each (no list cell to overflow)."""
    return (keyed.filter("phone IS NOT NULL AND reject IS NULL AND name <> ''")
            .select("lead_key", "name").distinct())


def golden_files(keyed: DataFrame) -> DataFrame:
    """Every distinct source file of a contact, one row each."""
    return (keyed.filter("phone IS NOT NULL AND reject IS NULL")
            .select("lead_key", "file_name").distinct())


def golden_phones(keyed: DataFrame) -> DataFrame:
    """Every distinct phone text of a contact as it was written, one row each."""
    return (keyed.filter("phone IS NOT NULL AND reject IS NULL")
            .select("lead_key", F.trim("raw_phone").alias("raw_phone")).distinct())


def joined_list(members: DataFrame, value: str, alias: str, limit: int | None = None) -> DataFrame:
    """First value and number of the distinct members of every contact, and their ', '-joined sorted text for display.

    With a ``limit`` only contacts of at most that many members get the text,
    the others null, and no list is longer: members are counted before any is
    gathered.  First value and count cover all members in either case.
    """
    sizes = members.groupBy("lead_key").agg(F.min(value).alias(f"{alias}_first"), F.count("*").alias(f"{alias}_count"))
    short = members if limit is None else members.join(sizes.filter(F.col(f"{alias}_count") <= limit).select("lead_key"), "lead_key", "left_semi")
    texts = short.groupBy("lead_key").agg(F.array_join(F.sort_array(F.collect_list(value)), ", ").alias(alias))
    return sizes.join(texts, "lead_key", "left").select("lead_key", alias, f"{alias}_first", f"{alias}_count")


def merge_duplicates(duplicates: DataFrame, contacts: DataFrame, stored_files: DataFrame) -> DataFrame:
    """Stored contacts filled up from duplicate rows of the same phone.

    The duplicates are reduced to one row per phone before the join;
    ``stored_files`` (phone, file_name) are the files a contact already counts.
    """
    order = F.struct("file_name", "pos")

    def first_filled(name: str) -> Column:
        return F.min_by(name, F.when(F.coalesce(F.col(name), F.lit("")) != "", order)).alias(f"new_{name}")

    extra = (with_tier(duplicates.filter("phone IS NOT NULL")).groupBy("phone").agg(
        first_filled("name"), first_filled("email"), first_filled("uid"), first_filled("link"),
        F.min_by(F.struct("source_tier", "source_weight"),
                 F.struct((-F.col("source_weight")).alias("w"), "file_name", "pos")).alias("best")))
    more = (duplicates.filter("phone IS NOT NULL").select("phone", "file_name").distinct()
            .join(stored_files, ["phone", "file_name"], "left_anti")
            .groupBy("phone").agg(F.count("*").alias("new_files")))

    def filled(name: str) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.col(f"new_{name}"), F.lit("")).alias(name)

    better = F.col("best.source_weight") > F.col("source_weight")
    return contacts.join(extra, "phone", "left").join(more, "phone", "left").select(
        "phone", filled("name"), filled("email"), filled("uid"), filled("link"),
        F.when(better, F.col("best.source_tier")).otherwise(F.col("source_tier")).alias("source_tier"),
        F.when(better, F.col("best.source_weight")).otherwise(F.col("source_weight")).alias("source_weight"),
        (F.col("source_count") + F.coalesce("new_files", F.lit(0))).alias("source_count"))


def upsert(old: DataFrame, old_files: DataFrame | None, new: DataFrame, new_files: DataFrame) -> DataFrame:
    """Golden contacts of a new batch merged into the stored ones (one row per key each).

    Without ``old_files``, ``new_files`` are the distinct files of both.
    """
    files = new_files if old_files is None else old_files.unionByName(new_files).distinct()
    sources = files.groupBy("lead_key").agg(F.count("*").alias("n_files"))
    o, n = old.alias("o"), new.alias("n")

    stored = F.col("o.lead_key").isNotNull()
    merged = F.col("o.phone").isNotNull()  # e-mail-only contacts keep what is stored

    def filled(name: str) -> Column:
        return F.when(stored & ((F.col(f"o.{name}") != "") | ~merged), F.col(f"o.{name}")).otherwise(
            F.coalesce(F.col(f"n.{name}"), F.col(f"o.{name}"), F.lit(""))).alias(name)

    better = ~stored | (merged & (F.col("n.source_weight") > F.col("o.source_weight")))
    wider = ~stored | (merged & (F.length("n.address") > F.length("o.address")))
    return (
        o.join(n, F.col("o.lead_key") == F.col("n.lead_key"), "full_outer")
        .select(
            F.coalesce("o.lead_key", "n.lead_key").alias("lead_key"),
            F.coalesce("o.phone", "n.phone").alias("phone"),
            filled("email"), filled("name"), filled("uid"), filled("link"),
            F.when(F.coalesce(wider, F.lit(False)), F.col("n.address")).otherwise(F.col("o.address")).alias("address"),
            F.when(F.coalesce(better, F.lit(False)), F.col("n.source_tier")).otherwise(F.col("o.source_tier")).alias("source_tier"),
            F.when(F.coalesce(better, F.lit(False)), F.col("n.source_weight")).otherwise(F.col("o.source_weight")).alias("source_weight"),
            F.greatest("o.latest_file_date", "n.latest_file_date").alias("latest_file_date"),
            F.coalesce("o.file_source", "n.file_source").alias("file_source"),
            F.coalesce("o.note", "n.note").alias("note"),
            F.coalesce("o.source", "n.source").alias("source"))
        .join(sources, "lead_key", "left")
        .withColumn("source_count", F.coalesce("n_files", F.lit(1).cast("bigint")))
        .drop("n_files")
    )


def reconcile(rows: DataFrame, per: list[str] | None = None) -> DataFrame:
    """uid, name, phone rows -> mapped / no_phone / no_name per file (or across files).

    Of several names or phones of a uid the last one in row order counts.
    """
    keys = [*(["file_name"] if per is None else per), "uid"]
    at = F.struct("file_name", "pos")
    return (
        rows.filter("uid IS NOT NULL").groupBy(*keys).agg(
            F.max_by("name", F.when(F.coalesce(F.col("name"), F.lit("")) != "", at)).alias("name"),
            F.max_by("phone", F.when(F.col("phone").isNotNull(), at)).alias("phone"))
        .filter("name IS NOT NULL OR phone IS NOT NULL")
        .withColumn("status", F.when(F.col("phone").isNull(), "no_phone")
                    .when(F.col("name").isNull(), "no_name").otherwise("mapped"))
    )

"""Reporting queries: counts, summaries, rankings, lookups."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom import dictionaries as D
from leadloom.functions import phones as P
from leadloom.functions import text as T
from leadloom.functions.numbers import exact_avg, half_up, rate


def province_counts(contacts: DataFrame, provinces: list[str] | None = None) -> DataFrame:
    """Contacts per listed province by address, and the remainder; one pass."""
    provinces = provinces or D.SNAPSHOT_PROVINCES
    low = F.lower("address")
    counts = contacts.agg(F.count("*").alias("total"),
                          *[F.count_if(low.contains(p.lower())).alias(f"n{i}") for i, p in enumerate(provinces)])
    listed = sum((F.col(f"n{i}") for i in range(1, len(provinces))), F.col("n0"))
    entries = [F.struct(F.lit(p).alias("province"), F.col(f"n{i}").alias("contacts")) for i, p in enumerate(provinces)]
    entries.append(F.struct(F.lit(D.SNAPSHOT_OTHER).alias("province"),
                            F.greatest(F.lit(0), F.col("total") - listed).alias("contacts")))
    return counts.select(F.inline(F.array(*entries)))


def count_rows(counts: dict[str, tuple[DataFrame, Column | None]]) -> DataFrame:
    """(metric, value) of row counts; the counts of one table share a scan."""
    tables: dict[int, tuple[DataFrame, list]] = {}
    for metric, (df, cond) in counts.items():
        tables.setdefault(id(df), (df, []))[1].append((metric, cond))
    out = None
    for df, metrics in tables.values():
        row = df.agg(*[(F.count("*") if cond is None else F.count_if(cond)).alias(m) for m, cond in metrics])
        part = row.select(F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m, _ in metrics])))
        out = part if out is None else out.unionByName(part)
    return out


def score_summary(leads: DataFrame, col: str = "lead_score") -> DataFrame:
    s = F.col(col)
    return leads.agg(F.count_if(s >= 8).alias("vip"), F.count_if((s >= 5) & (s < 8)).alias("warm"),
                     F.count_if(s < 5).alias("cold"), exact_avg(s, 2).alias("avg_score"), F.max(s).alias("max_score"))


def order_statistics(df: DataFrame, col: str, ranks: list[int], low: float, high: float, bins: int = 1024, few: int = 10_000) -> dict[int, float]:
    """The values at 0-based ``ranks`` of the non-null values of a column, whose least and greatest are given.

    Histogram refinement: each pass counts the rows of ``bins`` equal bins of the
    range a rank lies in, with the least and greatest value of each bin, and goes on
    in the bin that holds the rank, until its values are equal or ``few``; those
    are read.  The state of a pass is one row per rank and bin, however many
    distinct values there are.
    """
    x = F.col(col).cast("double")
    done, ranges = {}, {r: (low, high, 0, None) for r in set(ranks)}  # rank: range, rows below it, rows in it
    while ranges:
        for r, (lo, hi, below, n) in list(ranges.items()):
            if lo == hi:
                done[r] = lo
                del ranges[r]
            elif n is not None and n <= few:
                done[r] = sorted(v[0] for v in df.filter(x.between(lo, hi)).select(x).collect())[r - below]
                del ranges[r]
        if not ranges:
            break
        spans = list(dict.fromkeys((lo, hi) for lo, hi, _, _ in ranges.values()))
        # a bin's number only has to rise with the value
        options = [F.when(x.between(lo, hi), F.struct(F.lit(i).alias("span"), F.least(
            F.floor((x / 2 - lo / 2) / (hi / 2 - lo / 2) * bins), F.lit(bins - 1)).alias("bin"))) for i, (lo, hi) in enumerate(spans)]
        found = (df.select(x.alias("x"), F.explode(F.array_compact(F.array(*options))).alias("o")).groupBy("o.span", "o.bin")
                 .agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect())  # spans x bins rows
        by_span = {i: sorted((f["bin"], f["n"], f["lo"], f["hi"]) for f in found if f["span"] == i) for i in range(len(spans))}
        for r, (lo, hi, below, _) in ranges.items():
            for _, n, first, last in by_span[spans.index((lo, hi))]:
                if r < below + n:
                    ranges[r] = (first, last, below, n)
                    break
                below += n
    return done


def quantiles(df: DataFrame, col: str, probabilities: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation, in state that does not depend on the number of distinct values."""
    x = F.col(col).cast("double")
    n, low, high = df.agg(F.count(x), F.min(x), F.max(x)).first()
    if not n:
        return [None] * len(probabilities)
    places = [(n - 1) * p for p in probabilities]
    values = order_statistics(df, col, [int(i) for p in places for i in (p // 1, -(-p // 1))], low, high)
    return [values[int(p // 1)] if p == p // 1 else (-(-p // 1) - p) * values[int(p // 1)] + (p - p // 1) * values[int(-(-p // 1))] for p in places]


def describe(df: DataFrame, col: str) -> DataFrame:
    """count, mean, std, min, exact quartiles and max of a column, which should be one of a written table: several passes read it."""
    x = F.col(col).cast("decimal(18,4)")
    n, s, q = F.col("n").cast("double"), F.col("s").cast("double"), F.col("q").cast("double")
    agg = df.agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum((x * x).cast("decimal(28,8)")).alias("q"),
                 F.min(col).alias("min"), F.max(col).alias("max"))
    p25, p50, p75 = (F.lit(v).cast("double") for v in quantiles(df, col, [0.25, 0.5, 0.75]))
    return agg.select(
        F.col("n").alias("count"), half_up(s / n, 4).alias("mean"),
        half_up(F.sqrt((q - s * s / n) / (n - 1)), 4).alias("std"), "min", half_up(p25, 4).alias("p25"),
        half_up(p50, 4).alias("p50"), half_up(p75, 4).alias("p75"), "max")


def group_summary(df: DataFrame, label: Column, alias: str, score: str, places: int) -> DataFrame:
    """Count and mean score per label."""
    return df.groupBy(label.alias(alias)).agg(
        F.count("*").alias("contacts"), exact_avg(F.coalesce(F.col(score), F.lit(0.0)), places).alias("avg_score"))


def counts_with_share(df: DataFrame, label: Column, alias: str) -> DataFrame:
    """Count per label and its share; the window runs over the few label rows."""
    counts = df.groupBy(label.alias(alias)).agg(F.count("*").alias("contacts"))
    total = F.sum("contacts").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("share_pct", rate(F.col("contacts"), total, 1, 100))


def top_counts(df: DataFrame, col: str, n: int) -> DataFrame:
    return (df.groupBy(col).agg(F.count("*").alias("contacts"))
            .orderBy(F.desc("contacts"), col).limit(n))


def coverage(contacts: DataFrame) -> DataFrame:
    def has(col: str) -> Column:
        return F.count_if(F.coalesce(F.col(col), F.lit("")) != "")

    total = F.col("total")
    return contacts.agg(
        F.count("*").alias("total"), has("phone").alias("has_phone"), has("email").alias("has_email"),
        has("uid").alias("has_uid"), F.count_if(F.col("province") != "Unknown").alias("has_province"),
        F.count_if(F.col("source_count") > 1).alias("cross_source"),
        F.count_if(F.col("unified_score") >= 70).alias("grade_a_plus"),
    ).withColumns({f"{m}_pct": rate(F.col(m), total, 2, 100)
                   for m in ("has_phone", "has_email", "cross_source", "grade_a_plus")})


def grade_bucket(score: Column) -> Column:
    out = F.lit(D.GRADE_BUCKETS["D"])
    for bound, letter, _ in reversed(D.GRADES[:-1]):
        out = F.when(score >= bound, F.lit(D.GRADE_BUCKETS[letter])).otherwise(out)
    return out


def tier_report(files: DataFrame) -> DataFrame:
    """Files, total MB and mean weight per tier label."""
    tiers = T.classify_files(files)
    return tiers.groupBy("label").agg(
        F.count("*").alias("files"), half_up(F.sum("size_bytes").cast("double") / F.lit(1048576.0), 1).alias("total_mb"),
        exact_avg(F.col("weight"), 2).alias("avg_weight"))


def audit(files: DataFrame) -> DataFrame:
    """Category of every file; vague names form a category of their own."""
    return files.select(
        "file_name", F.when(T.file_meaningless(F.col("file_name")), F.lit(D.FILE_MEANINGLESS))
        .otherwise(T.file_category(F.col("file_name"))).alias("category"),
        half_up(F.col("size_bytes") / F.lit(1024.0), 2).alias("size_kb"))


def lookup(contacts: DataFrame, queries: list[str], written: DataFrame | None = None) -> DataFrame:
    """Contacts that match any of the search texts by phone, e-mail or part of the name, one row per match.

    Every contact is tested against the list, an argument, in one scan.
    ``written`` (lead_key, raw_phone) adds the contacts with a phone that was written as the text.
    """
    texts = F.transform(F.array(*[F.lit(q) for q in queries]), lambda q: F.struct(
        q.alias("query"), P.lookup_text(q).alias("q")))

    def hit(entry):
        q = entry["q"]
        return F.coalesce((F.col("phone") == q) | (F.col("email") == F.lower(q))
                          | F.lower("name").contains(F.lower(q)), F.lit(False))

    found = contacts.select(F.explode(F.filter(texts, hit)).alias("hit"), "lead_key", "phone", "email", "name").select(
        F.col("hit.query").alias("query"), "lead_key", "phone", "email", "name")
    if written is None:
        return found
    asked = [q.strip() for q in queries if q.strip()]
    hits = written.filter(F.col("raw_phone").isin(asked)).select("lead_key", F.col("raw_phone").alias("query"))
    more = contacts.join(hits, "lead_key").select("query", "lead_key", "phone", "email", "name")
    return found.unionByName(more).distinct()


def grams(text: Column, sizes: Column | list[int]) -> Column:
    """All distinct stretches of a text with the given numbers of characters."""
    sizes = F.array(*[F.lit(n) for n in sizes]) if isinstance(sizes, list) else sizes
    every = F.flatten(F.transform(sizes, lambda n: F.transform(
        F.sequence(F.lit(1), F.greatest(F.char_length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n))))
    return F.array_distinct(every)


def name_matches(contacts: DataFrame, texts: DataFrame) -> DataFrame:
    """(q, name) of all texts ``q`` that are part of a contact's name, both as written, letters compared in lower case.

    An inverted index joins them: every distinct name lists its stretches of up
    to three characters, of which only those that some text has are kept; a text
    looks under the one of its own that the fewest names have, and the names found
    there are verified.  So no text meets all names, however many there are of
    both.  Blank texts are part of no name.
    """
    names = contacts.filter("name <> ''").select("name", F.lower("name").alias("lower")).distinct()
    asked = texts.filter("trim(q) <> ''").select("q").distinct().withColumn("needle", F.lower("q"))
    size = F.least(F.char_length("needle"), F.lit(3))
    wanted = asked.select("q", "needle", F.explode(grams(F.col("needle"), F.array(size))).alias("gram"))
    index = names.select("name", "lower", F.explode(grams(F.col("lower"), [1, 2, 3])).alias("gram")).join(
        wanted.select("gram").distinct(), "gram", "left_semi")
    listed = index.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = (wanted.join(listed, "gram", "left").groupBy("q", "needle")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least")))
    found = rarest.filter("least.n > 0").select("q", "needle", F.col("least.gram").alias("gram")).join(index, "gram")
    return found.filter(F.col("lower").contains(F.col("needle"))).select("q", "name")


def lookup_texts(contacts: DataFrame, queries: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """Matches of a table of search texts, of any size: by phone, e-mail, part of the name and phone as written, one row per match.

    Four equi-joins and no comparison of all texts with all contacts.  A text
    that finds a contact in several ways gives one row; blank texts match nothing.
    ``written`` (lead_key, raw_phone) adds the contacts with a phone that was written as the text.
    """
    cols = ["query", "lead_key", "phone", "email", "name"]
    q = queries.select("query", P.lookup_text(F.col("query")).alias("q"))
    by_name = q.join(name_matches(contacts, q), "q").join(contacts, "name").select(*cols)
    found = lookup_keys(contacts, queries).unionByName(by_name)
    if written is not None:
        asked = queries.select("query", F.trim("query").alias("raw_phone")).filter("raw_phone <> ''")
        hits = asked.join(written, "raw_phone").select("lead_key", F.col("raw_phone").alias("query"))
        found = found.unionByName(contacts.join(hits, "lead_key").select(*cols))
    return found.distinct()


def lookup_keys(contacts: DataFrame, queries: DataFrame) -> DataFrame:
    """Exact phone and e-mail matches of a table of search texts; blank ones match nothing."""
    q = queries.select("query", P.lookup_text(F.col("query")).alias("q")).filter("q <> ''")
    by_phone = q.join(contacts.filter("phone <> ''"), F.col("q") == F.col("phone"))
    by_email = q.join(contacts.filter("email <> ''"), F.lower("q") == F.col("email"))
    cols = ["query", "lead_key", "phone", "email", "name"]
    return by_phone.select(*cols).unionByName(by_email.select(*cols)).distinct()


def profile_search(leads: DataFrame, q: str, n: int = 20) -> DataFrame:
    if len(q.strip()) < 2:
        return leads.limit(0)
    q = q.strip()
    return (leads.filter(F.col("phone").contains(q) | F.col("name").contains(q) | F.col("uid").contains(q))
            .orderBy(F.desc("lead_score"), "profile_key").limit(n))


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, order: list[tuple[str, bool]], after: tuple | None, size: int) -> DataFrame:
    """The ``size`` rows that follow the row with the keys ``after`` (None: the first ones), in an order of (column, rising) that tells rows apart.

    A filter on the keys and a bounded top-n per task: unlike by an offset, the
    rows before a page are neither sorted nor counted, however late the page.
    Keys are not null.
    """
    later, equal = F.lit(False), F.lit(True)
    for (name, rising), value in zip(order, after or (), strict=False):
        beyond = F.col(name) > F.lit(value) if rising else F.col(name) < F.lit(value)
        later, equal = later | (equal & beyond), equal & (F.col(name) == F.lit(value))
    rows = df if after is None else df.filter(later)
    return rows.orderBy(*[F.asc(name) if rising else F.desc(name) for name, rising in order]).limit(size)


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    cols = snapshots.columns
    return snapshots.agg(F.max_by(F.struct(*cols), "snapshot_time").alias("s")).select("s.*")


def top_values_code(df: DataFrame, col: str, alias: str, n: int = 10) -> DataFrame:
    """Code of the n most frequent values and 'Other', numbered alphabetically."""
    top = (df.groupBy(col).agg(F.count("*").alias("_c")).filter(F.col(col).isNotNull())
           .orderBy(F.desc("_c"), col).limit(n).select(F.col(col).alias("_top")))
    names = sorted({r["_top"] for r in top.collect()} | {"Other"})  # n + 1 values at most
    code = F.create_map(*[x for i, name in enumerate(names) for x in (F.lit(name), F.lit(i))])
    return df.withColumn(alias, F.coalesce(F.element_at(code, F.col(col)), F.lit(names.index("Other"))))

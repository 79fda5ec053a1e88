"""The three batch phases over the tables of a data folder.

Every phase reads tables and writes tables, so a phase can be repeated on its
own.  ``as_of`` is the day the run stands for; nothing reads the clock.

    ingest(spark, inbox, data, run_ts)   files -> raw, contacts, members, rejects, stats
    enrich(spark, data, as_of)           interactions, listings -> hot leads, profiles
    score(spark, data, as_of)            contacts, hot leads -> scores, clusters, call list
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators import cluster as C
from leadloom.operators import enrich as E
from leadloom.operators import kmeans as K
from leadloom.operators import resolve as R
from leadloom.operators import score as S
from leadloom.sources import contact_files as CF
from leadloom.sources import sinks as SK
from leadloom.session import staged
from leadloom.store import ContactStore

BATCHES = 8  # of a mini-batch pass over the contacts
RAW_COLUMNS = ["raw_name", "raw_phone", "raw_email", "raw_address", "raw_source", "raw_campaign", "raw_note", "raw_uid", "raw_link"]


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def identities(spark: SparkSession, path: str) -> DataFrame:
    """uid, name and phone of identity files, last value per uid and file, as contact rows."""
    lines = CF.read_lines(spark, path, quoted=True)
    rows = CF.read_identities(lines).withColumn("file_name", F.col("file")).withColumn("pos", F.col("at"))
    kept = R.reconcile(rows).filter("status = 'mapped'")
    place = rows.groupBy("file", "uid").agg(F.max("at").alias("at"), F.max("modified").alias("modified"))
    return (kept.join(place, (F.col("file_name") == F.col("file")) & (kept["uid"] == place["uid"]))
            .select("file", "at", "modified", kept["uid"].alias("raw_uid"), F.col("name").alias("raw_name"), F.col("phone").alias("raw_phone")))


def raw_contacts(spark: SparkSession, inbox: str) -> DataFrame:
    """Rows of an inbox in canonical columns: folders ``csv`` and ``txt``, and where present ``documents`` and ``identities``.

    ``file_date`` is the day a file was last changed.
    """
    lines = CF.read_lines(spark, f"{inbox}/txt")
    social = CF.social_rows(lines).select(
        "file", "at", "modified", *[F.col(a).alias(b) for a, b in (("name", "raw_name"), ("phone", "raw_phone"), ("email", "raw_email"),
                                                                  ("uid", "raw_uid"), ("link", "raw_link"))])
    parts = [CF.read_contact_csv(spark, f"{inbox}/csv"), social, CF.plain_phone_files(lines)]
    if _exists(spark, f"{inbox}/documents"):
        parts.append(CF.read_documents(spark, f"{inbox}/documents"))
    if _exists(spark, f"{inbox}/identities"):
        parts.append(identities(spark, f"{inbox}/identities"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    name = F.element_at(F.split("file", "/"), -1)
    return out.select(name.alias("file_name"), F.struct("file", "at").alias("pos"), *RAW_COLUMNS, F.col("modified").alias("file_date"))


def ingest(spark: SparkSession, inbox: str, data: str, run_ts: str, buckets: int = 256) -> dict[str, DataFrame]:
    """Clean, de-duplicate against stored contacts, merge, and report.

    A run reads only versions of earlier runs and replaces its own tables, so
    that it can be repeated.  Its own contacts are kept beside the merged version;
    a late run for an earlier day is merged where it belongs, and the versions
    after it are merged again.  Reading and rewriting are confined to the
    ``buckets`` of the store that the run's keys fall into.
    """
    raw = _write(raw_contacts(spark, inbox), f"{data}/raw_contacts/run={run_ts}")
    keyed = _write(R.lead_keys(R.clean(raw)), f"{data}/clean_rows/run={run_ts}")
    store = ContactStore(spark, f"{data}/contacts", buckets)
    runs = sorted({*store.versions(), run_ts})
    at = runs.index(run_ts)
    base = runs[at - 1] if at else None
    marked = _write(R.mark_status(keyed, store.known_keys(keyed, base)), f"{data}/marked/run={run_ts}")
    SK.rejects_export(R.rejects(marked).drop("pos"), f"{data}/rejects", run_ts)
    own = f"{data}/own_contacts/run={run_ts}"
    names = marked.select("file_name").distinct()
    _write(R.golden_files(keyed), f"{own}/files")
    _write(R.golden(keyed, names), f"{own}/golden")
    for run in runs[at:]:
        contacts, files = (spark.read.parquet(f"{data}/own_contacts/run={run}/{part}") for part in ("golden", "files"))
        store.merge(contacts, files, run, base)
        base = run
    return {"contacts": store.contacts(run_ts), "stats": R.ingest_stats(marked)}


def enrich(spark: SparkSession, data: str, interactions: DataFrame, listings: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """Hot leads matched to profiles; unmatched listings become profiles."""
    contacts = ContactStore(spark, f"{data}/contacts").contacts()
    known = E.profiles_of(contacts)
    hot = E.social_hot_leads(interactions, as_of).unionByName(E.listing_hot_leads(listings))
    matched = _write(E.match_hot_leads(hot, known), f"{data}/hot_leads")
    profiles = _write(known.unionByName(E.new_profiles(matched)), f"{data}/profiles")
    return {"hot_leads": matched, "profiles": profiles}


def score(spark: SparkSession, data: str, as_of: str) -> DataFrame:
    """Unified scores and personas of the contacts, three clusters and the lead score of every profile: the call list."""
    contacts = ContactStore(spark, f"{data}/contacts").contacts()
    scored = _write(S.rescore(contacts, as_of), f"{data}/scored_contacts")
    table = staged(C.features_v3(scored, "province"), "features")
    rows = K.points(C.impute_scale(table, C.FEATURES_V3), "lead_key", BATCHES)
    named = K.with_persona(K.with_cluster(table, "lead_key", K.labelled(rows, K.fit_best(rows, batches=BATCHES)[0])))
    _write(named.select("lead_key", F.col("cluster_raw").alias("cluster"), "persona"), f"{data}/personas")
    profiles, hot = spark.read.parquet(f"{data}/profiles"), spark.read.parquet(f"{data}/hot_leads")
    full = _write(E.with_contact_analytics(E.with_hot(profiles, hot), scored), f"{data}/profile_features")
    table = staged(E.features(full), "features")
    rows = K.points(C.impute_scale(table, C.FEATURES), "profile_key")
    labelled = K.with_cluster(table, "profile_key", K.labelled(rows, K.fit(rows, 3)))
    clusters = C.ranked_clusters(labelled).select("profile_key", "cluster", "cluster_label")
    return _write(E.with_lead_score(full.join(clusters, "profile_key", "left")), f"{data}/call_list")

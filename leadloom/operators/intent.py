"""Purchase intent of chat conversations.

Messages are a table (key, idx, sender, text, ts_text).  A conversation may be
very long, so per-conversation results come from aggregates and from blocks of
messages, never from one task that holds a whole conversation.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom import dictionaries as D
from leadloom.functions import dates as DT
from leadloom.functions import text as T
from leadloom.functions.numbers import half_up
from leadloom.operators.common import blocked_lag, blocked_row_number, computed_once, top_per_key
from leadloom.session import staged

CATEGORIES = list(D.INTENT_CATEGORIES)


def _signal(text: Column, order: int, category: str, pattern: str, score: float, label: str) -> Column:
    around = F.trim(F.regexp_extract(text, ".{0,10}?(?:" + pattern + ").{0,20}", 0))
    return F.when(T.found(text, pattern), F.struct(
        F.lit(order).alias("ord"), F.lit(category).alias("category"), F.lit(label).alias("label"),
        F.lit(float(score)).alias("score"), F.concat(F.lit("..."), around, F.lit("...")).alias("snippet")))


def message_signals(messages: DataFrame, signals: list | None = None) -> DataFrame:
    """Customer messages with the array of their signals, one array per category first."""
    signals = signals or D.INTENT_SIGNALS
    rows = computed_once(messages.filter("sender = 'customer'"), {"norm": T.message_normalise(F.col("text"))})
    cols = {}
    for category in CATEGORIES:
        hits = [_signal(F.col("norm"), i, cat, p, s, label) for i, (cat, p, s, label) in enumerate(signals) if cat == category]
        if hits:
            cols[f"_{category}"] = F.array_compact(F.array(*hits))
    return rows.withColumns(cols).withColumn("signals", F.concat(*cols)).drop(*cols)


def extract_signals(messages: DataFrame, key: str = "conv_id", signals: list | None = None) -> DataFrame:
    """One row per message and matching pattern."""
    return message_signals(messages, signals).select(key, "idx", F.explode("signals").alias("s")).select(
        key, "idx", "s.*")


def category_scores(messages: DataFrame, found: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation: message counts, and raw and normalised score per category."""
    base = messages.groupBy(key).agg(F.count("*").alias("message_count"),
                                     F.count_if(F.col("sender") == "customer").alias("customer_message_count"))
    aggs = [F.count("*").alias("n_signals")]
    for cat in CATEGORIES:
        score = F.when(F.col("category") == cat, F.col("score"))
        aggs += [F.max(score).alias(f"_max_{cat}"), F.sum(F.when(score > 0, score)).alias(f"_pos_{cat}")]
    wide = base.join(found.groupBy(key).agg(*aggs), key, "left").withColumn("n_signals", F.coalesce("n_signals", F.lit(0)))
    raw, norm = {}, {}
    for cat in CATEGORIES:
        positive = F.coalesce(F.col(f"_pos_{cat}"), F.lit(0.0))
        raw[f"raw_{cat}"] = F.coalesce(F.col(f"_max_{cat}") + F.lit(0.5) * F.least(positive * F.lit(0.1), F.lit(2.0)), F.lit(0.0))
        value = F.col(f"raw_{cat}")
        clipped = F.abs(value) if cat == "CONCERN" else F.greatest(F.lit(0.0), value)
        norm[f"norm_{cat}"] = half_up(F.least(F.lit(10.0), clipped), 1)
    return (wide.withColumns(raw).withColumns(norm)
            .withColumns({f"raw_{cat}": half_up(F.col(f"raw_{cat}"), 2) for cat in CATEGORIES})
            .drop(*[f"_{m}_{cat}" for m in ("max", "pos") for cat in CATEGORIES]))


def category_rows(scores: DataFrame, key: str = "conv_id") -> DataFrame:
    """The wide scores as one row per category."""
    return scores.select(key, F.inline(F.array(*[F.struct(
        F.lit(cat).alias("category"), F.col(f"raw_{cat}").alias("raw_score"), F.col(f"norm_{cat}").alias("normalized"))
        for cat in CATEGORIES])))


def composite() -> Column:
    """Weighted sum of the category scores minus 0.3 per concern point."""
    total = F.lit(0).cast("decimal(10,4)")
    for cat, (weight, _) in D.INTENT_CATEGORIES.items():
        factor = -0.3 if cat == "CONCERN" else weight
        total = total + F.col(f"norm_{cat}").cast("decimal(6,2)") * F.expr(f"CAST({factor} AS DECIMAL(4,2))")
    return half_up(F.least(F.lit(10), F.greatest(F.lit(0), total)), 1)


def stage() -> Column:
    has = {cat: F.col(f"raw_{cat}") != 0 for cat in CATEGORIES}
    s = D.STAGES
    return (F.when(has["TRANSACTION"] | has["SCHEDULING"], s["closing"])
            .when(has["QUALIFICATION"] | has["LEGAL_CHECK"], s["evaluating"])
            .when(has["RESEARCH"], s["collecting"]).otherwise(s["opening"]))


def response_time(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """Mean minutes between neighbouring messages of different senders (gaps under a day)."""
    timed = computed_once(messages.select(key, "idx", "sender", "ts_text"),
                          {"_ts": F.unix_timestamp(DT.chat_timestamp(F.col("ts_text")))}).filter("_ts IS NOT NULL")
    paired = blocked_lag(timed, key, "idx", F.struct("_ts", "sender"), "_before")
    gap = F.abs(F.col("_ts") - F.col("_before._ts"))
    counted = F.when((F.col("sender") != F.col("_before.sender")) & (gap > 0) & (gap < 86400), gap)
    return (paired.groupBy(key).agg(F.sum(counted).alias("_s"), F.count(counted).alias("_n"))
            .filter("_n > 0")
            .select(key, half_up(F.col("_s") / F.lit(60.0) / F.col("_n"), 1).alias("avg_response_time_min")))


def response_speed(minutes: Column) -> Column:
    out = F.lit(D.RESPONSE_SPEED[-1][1])
    for bound, label in reversed(D.RESPONSE_SPEED[:-1]):
        out = F.when(minutes <= bound, F.lit(label)).otherwise(out)
    return F.when(minutes.isNull(), D.RESPONSE_UNKNOWN).otherwise(out)


def progression(messages: DataFrame, key: str = "conv_id", signals: list | None = None, found: DataFrame | None = None) -> DataFrame:
    """Signals without concerns in the second half of the customer's messages against the first.

    ``found`` is the result of ``message_signals`` where it is at hand.
    """
    found = message_signals(messages, signals) if found is None else found
    rows = found.select(
        key, "idx", F.size(F.filter("signals", lambda s: s["category"] != "CONCERN")).alias("n"))
    placed = blocked_row_number(rows, key, "idx", "rn")
    early = F.col("rn") <= F.floor(F.col("rn_total") / 2)
    halves = placed.groupBy(key).agg(F.max("rn_total").alias("m"), F.sum(F.when(early, F.col("n")).otherwise(0)).alias("a"),
                                     F.sum(F.when(~early, F.col("n")).otherwise(0)).alias("b"))
    p = D.PROGRESSION
    return halves.select(key, F.when(F.col("m") < 3, p["short"]).when(F.col("b") > F.col("a") * 1.3, p["up"])
                         .when(F.col("b") < F.col("a") * 0.7, p["down"]).otherwise(p["flat"]).alias("progression"))


def summarise(scores: DataFrame) -> DataFrame:
    """Level, probability, next action, urgency, confidence and text per conversation."""
    c = F.col
    rows = scores.withColumn("composite_score", composite()).withColumn("conversation_stage", stage())
    score = c("composite_score")

    def level(pos):
        out = F.lit(D.INTENT_LEVELS[-1][pos])
        for entry in reversed(D.INTENT_LEVELS[:-1]):
            out = F.when(score >= entry[0], F.lit(entry[pos])).otherwise(out)
        return out

    trans, sched, qual, concern = (c(f"norm_{x}") for x in ("TRANSACTION", "SCHEDULING", "QUALIFICATION", "CONCERN"))

    def action(pos):
        a = D.NEXT_ACTIONS
        return (F.when((trans >= 8) | (sched >= 8), a["call_now"][pos]).when((trans >= 5) | (sched >= 6), a["call_24h"][pos])
                .when(qual >= 6, a["send_finance"][pos]).when(concern >= 4, a["handle_concern"][pos]).otherwise(a["nurture"][pos]))

    positive = [cat for cat in CATEGORIES if cat != "CONCERN"]
    entries = F.array(*[F.struct((-c(f"norm_{cat}")).alias("k"), F.lit(i).alias("i"), F.lit(D.INTENT_CATEGORIES[cat][1]).alias("label"))
                        for i, cat in enumerate(positive)])
    top = F.transform(F.slice(F.array_sort(F.filter(entries, lambda e: e["k"] < 0)), 1, 2), lambda e: e["label"])
    rows = rows.withColumns({
        "intent_level": level(1), "intent_color": level(2), "purchase_probability": level(3),
        "next_action": action(0), "urgency": action(1),
        "confidence": F.when(c("n_signals") >= 5, "high").when(c("n_signals") >= 2, "medium").otherwise("low"),
        "_focus": F.when(F.size(top) > 0, F.array_join(top, " & ")).otherwise("chung"),
        "_note": F.when(concern >= 3, F.concat(F.lit(" Có "), half_up(concern, 0).cast("int").cast("string"),
                                               F.lit(" điểm lo ngại cần xử lý."))).otherwise("")})
    return rows.withColumn("summary", F.concat(
        F.lit("Khách ở giai đoạn «"), c("conversation_stage"), F.lit("» với intent tập trung vào "), c("_focus"),
        F.lit(". Điểm tổng hợp "), score.cast("string"), F.lit("/10 — "), c("intent_level"), F.lit("."), c("_note"),
        F.lit(" Đề xuất: "), c("next_action"), F.lit("."))).drop("_focus", "_note")


def analyze(messages: DataFrame, key: str = "conv_id", signals: list | None = None) -> DataFrame:
    """Full result per conversation; the signals are extracted once, into a written table, for scores and progression."""
    found = staged(message_signals(messages, signals).select(key, "idx", "signals"), "signals")
    scores = category_scores(messages, found.select(key, "idx", F.explode("signals").alias("s")).select(key, "idx", "s.*"), key)
    return (summarise(scores).join(response_time(messages, key), key, "left").join(progression(messages, key, found=found), key, "left")
            .withColumn("response_speed", response_speed(F.col("avg_response_time_min")))
            .withColumn("progression", F.coalesce("progression", F.lit(D.PROGRESSION["short"]))))


def analyze_messages(messages: DataFrame, signals: list | None = None) -> DataFrame:
    """The same for every customer message on its own."""
    single = messages.filter("sender = 'customer'").withColumn("msg_key", F.concat_ws("#", "conv_id", "idx"))
    scores = category_scores(single, extract_signals(single, "msg_key", signals), "msg_key")
    return summarise(scores)


def with_empty(conversations: DataFrame, analyzed: DataFrame, key: str = "conv_id") -> DataFrame:
    """Conversations without messages get the default result."""
    e = D.EMPTY_CHAT
    return (conversations.join(analyzed, key, "left")
            .fillna({"composite_score": 0.0, "confidence": "low", "intent_level": D.INTENT_LEVELS[-1][1],
                     "purchase_probability": e["probability"], "conversation_stage": e["stage"], "progression": e["progression"],
                     "response_speed": e["response_speed"], "next_action": e["next_action"],
                     "urgency": D.NEXT_ACTIONS["nurture"][1], "summary": e["summary"], "message_count": 0}))


def top_signals(found: DataFrame, n: int = 6, key: str = "conv_id") -> DataFrame:
    """The n strongest positive signals, earlier ones first among equals."""
    return top_per_key(found.filter("score > 0"), key, [F.desc("score"), "idx", "ord"], n, F.col("idx"))


def last_messages(messages: DataFrame, n: int = 3, key: str = "conv_id") -> DataFrame:
    """The last n messages with a 60 character preview."""
    last = top_per_key(messages, key, [F.desc("idx")], n, F.col("idx"))
    preview = F.when(F.length("text") > 60, F.concat(F.substring("text", 1, 60), F.lit("…"))).otherwise(F.col("text"))
    return last.select(key, "idx", "sender", preview.alias("preview"))


# --- chat leads ------------------------------------------------------------
def chat_chunks(messages: DataFrame, key: str = "conv_id", block: int = 200) -> DataFrame:
    """Joined lower-case text of up to ``block`` messages, with the tail of what came before.

    Messages are counted first, so ``idx`` may have gaps (a time, for example).

    The tail keeps a phrase that runs over the border of two chunks visible.
    Only tails are ordered per conversation, and those in blocks.
    """
    counted = blocked_row_number(messages, key, "idx", "_n")
    rows = counted.withColumn("block", F.floor((F.col("_n") - 1) / block))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", F.coalesce("text", F.lit("")).alias("text")))),
                                      lambda m: m["text"]), " ")
    chunks = staged(rows.groupBy(key, "block").agg(F.lower(joined).alias("chunk")), "chunks")
    tails = chunks.select(key, "block", F.substring("chunk", -64, 64).alias("tail"))
    one = blocked_lag(tails, key, "block", F.struct("tail"), "_p1")
    two = blocked_lag(one, key, "block", F.struct(F.col("_p1.tail").alias("tail")), "_p2")
    return chunks.join(two.select(key, "block", F.concat_ws(" ", "_p2.tail", "_p1.tail").alias("before")), [key, "block"])


def stored_text(chunks: DataFrame, key: str, chars: int | None) -> DataFrame:
    """The joined text, or its first ``chars`` characters.

    Every chunk adds at least the joining blank, so ``chars`` + 1 chunks are enough.
    """
    texts = F.transform(F.sort_array(F.collect_list(F.struct("block", "chunk"))), lambda x: x["chunk"])
    if chars is None:
        return chunks.groupBy(key).agg(F.array_join(texts, " ").alias("full_text"))
    head = top_per_key(chunks.select(key, "block", F.substring("chunk", 1, chars).alias("chunk")), key, ["block"], chars + 1, F.col("block"))
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = head.withColumn("_start", F.coalesce(F.sum(F.length("chunk") + 1).over(before), F.lit(0))).filter(F.col("_start") <= chars)
    return placed.groupBy(key).agg(F.substring(F.array_join(texts, " "), 1, chars).alias("full_text"))


def chat_leads(messages: DataFrame, key: str = "conv_id", stored_chars: int | None = None) -> DataFrame:
    """Phone, e-mail, intent, message count, first sender and stored text per conversation."""
    chunks = chat_chunks(messages, key)
    text = F.concat_ws(" ", F.nullif("before", F.lit("")), "chunk")
    amount = r"[0-9]+\s*(tỷ|triệu|(tr|ty)([^\p{L}\p{N}_]|$))"
    tested = computed_once(chunks, {"_t": text}).withColumns({
        "_hits": F.array(*[F.col("_t").contains(w).cast("int") for w in D.HIGH_INTENT_WORDS + D.MEDIUM_INTENT_WORDS]),
        "_phone": T.chat_phone(F.col("chunk")), "_email": T.chat_email(F.col("chunk")),
        "_amount": F.col("_t").rlike(amount)})
    n_high, n_all = len(D.HIGH_INTENT_WORDS), len(D.HIGH_INTENT_WORDS) + len(D.MEDIUM_INTENT_WORDS)
    agg = tested.groupBy(key).agg(
        *[F.max(F.col("_hits")[i]).alias(f"_h{i}") for i in range(n_all)],
        F.min_by("_phone", F.when(F.col("_phone").isNotNull(), F.col("block"))).alias("phone"),
        F.min_by("_email", F.when(F.col("_email").isNotNull(), F.col("block"))).alias("email"),
        F.bool_or("_amount").alias("_amount"))
    stored = stored_text(chunks, key, stored_chars)
    senders = messages.groupBy(key).agg(F.count("*").alias("message_count"),
                                        F.min_by("sender", F.when(F.col("sender") != "agent", F.col("idx"))).alias("first_sender"))
    score = T.chat_intent_from_hits(sum((F.col(f"_h{i}") for i in range(1, n_high)), F.col("_h0")),
                                    sum((F.col(f"_h{i}") for i in range(n_high + 1, n_all)), F.col(f"_h{n_high}")),
                                    F.col("phone").isNotNull(), F.col("_amount"))
    return (senders.join(agg, key).join(stored, key, "left")
            .select(key, "phone", "email", "message_count", "first_sender", score.alias("intent_score"), "full_text"))


def conversation_upsert(stored: DataFrame, fresh: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Known conversations take the new count, score and time; unknown ones are added."""
    s, f = stored.alias("s"), fresh.alias("f")
    renewed = ("message_count", "intent_score", "last_message_at")
    cols = [F.coalesce(f"f.{c}", f"s.{c}").alias(c) if c in renewed or c == key else F.coalesce(f"s.{c}", f"f.{c}").alias(c)
            for c in fresh.columns]
    return s.join(f, F.col(f"s.{key}") == F.col(f"f.{key}"), "full_outer").select(*cols)

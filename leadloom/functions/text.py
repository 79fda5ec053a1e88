"""Names, e-mails, addresses, file names and keyword tests as Column expressions."""

import re
from re import _parser as _regex

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import dictionaries as D

_EMAIL = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+$"


def blank_to_null(value: Column) -> Column:
    """Null for blanks and the text 'nan' that empty cells leave behind."""
    text = F.trim(value.cast("string"))
    # 'nan' and a line end, which stays, have 5 characters at most
    return F.when(F.length(text) > 5, text).when(~F.lower(text).isin("", "nan"), F.regexp_replace(text, "(?i)^nan$", ""))


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def keyword_count(text: Column, words: list[str]) -> Column:
    """How many words of the list occur in the (lower-cased) text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0)
    for word in words:
        total = total + low.contains(word).cast("int")
    return total


def email_valid(email: Column) -> Column:
    return F.coalesce(F.trim(email).rlike(_EMAIL), F.lit(False))


def email_clean(email: Column) -> Column:
    """Lower-cased address, null when it is no valid one."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(email), _EMAIL, 0)), F.lit(""))


def name_clean(name: Column) -> Column:
    """'' for null words, blanks collapsed, each word capitalised."""
    raw = F.coalesce(name.cast("string"), F.lit(""))
    spaced = contains_any(raw, ["  ", "\t", "\n", "\x0b", "\f", "\r"])  # most names have nothing to collapse
    squeezed = F.trim(F.when(spaced, F.regexp_replace(raw, r"\s+", " ")).otherwise(raw))
    null_word = (F.length(raw) <= max(map(len, D.NULL_NAME_WORDS))) & F.lower(raw).isin(D.NULL_NAME_WORDS)
    return F.when(null_word, F.lit("")).otherwise(F.initcap(squeezed))


def name_compose(name: Column, first: Column, last: Column) -> Column:
    """The full name, else 'last first' of wide CRM exports."""
    return F.coalesce(blank_to_null(name),
                      F.nullif(F.trim(F.concat_ws(" ", blank_to_null(last), blank_to_null(first))),
                               F.lit("")))


def name_first(name: Column) -> Column:
    """Last word of the name."""
    return F.element_at(F.split(F.trim(F.coalesce(name, F.lit(""))), " "), -1)


def name_last(name: Column) -> Column:
    """All words but the last."""
    words = F.split(F.trim(F.coalesce(name, F.lit(""))), " ")
    return F.when(F.size(words) > 1,
                  F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")).otherwise("")


def uid_extract(text: Column) -> Column:
    """First run of nine or more digits."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), "([0-9]{9,})", 1), F.lit(""))


def place_text(address: Column, file_name: Column) -> Column:
    """Text searched for a province; compute it once as a column of its own."""
    return F.lower(F.concat_ws(" ", F.coalesce(address, F.lit("")), F.coalesce(file_name, F.lit(""))))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def province_in(place: str) -> Column:
    """Province named in the ``place_text`` column called ``place``.

    The names are one constant list, not ninety branches: with these, the code of a
    stage that scores contacts passes the 8,000 bytes up to which Java compiles a method.
    """
    whens = [(f"{place} RLIKE {_quoted('|'.join(words))}", label) for label, words in D.PROVINCE_PRIORITY]
    names = ", ".join(f"({_quoted(n.lower())}, {_quoted(D.PROVINCE_ALIASES.get(n, n))})" for n in D.PROVINCE_NAMES)
    named = f"get(filter(array({names}), _listed -> contains({place}, _listed.col1)), 0).col2"
    return F.expr("CASE " + " ".join(f"WHEN {cond} THEN {_quoted(label)}" for cond, label in whens) + f" ELSE coalesce({named}, 'Unknown') END")


def with_province(rows: DataFrame, address: Column, file_name: Column, alias: str = "province") -> DataFrame:
    return (rows.withColumn("_place", place_text(address, file_name))
            .withColumn(alias, province_in("_place")).drop("_place"))


def source_from_content(*cells: Column) -> Column:
    """Channel named anywhere in the row or its file name."""
    text = F.lower(F.concat_ws(" ", *cells))
    out = F.lit("Unknown")
    for label, words in reversed(D.SOURCE_WORDS):
        out = F.when(text.rlike("|".join(words)), F.lit(label)).otherwise(out)
    return out


def has_vip_word(*cells: Column) -> Column:
    text = F.lower(F.concat(*[F.coalesce(c, F.lit("")) for c in cells]))
    return text.rlike("|".join(D.VIP_WORDS))


def url_domain(url: Column) -> Column:
    """Host without www."""
    return F.replace(F.try_parse_url(url, F.lit("HOST")), F.lit("www."), F.lit(""))


def classify_files(files: DataFrame, tiers: list | None = None) -> DataFrame:
    """Tier, weight, label, confidence and number of matching patterns per file name.

    The tier of the highest weight with a matching pattern wins; of two equal
    weights the earlier one.
    """
    tiers = tiers or D.TIERS
    counted = files.withColumns({f"_n{i}": F.expr(" + ".join(f"CAST(file_name RLIKE r'(?iu){p}' AS INT)" for p in patterns))
                                 for i, (_, _, _, _, patterns) in enumerate(tiers)})
    by_weight = sorted(range(len(tiers)), key=lambda i: (-tiers[i][1], i))

    def pick(value, default):
        return F.expr("CASE " + " ".join(f"WHEN _n{i} > 0 THEN {value(i)}" for i in by_weight) + f" ELSE {default} END")

    unknown = D.UNKNOWN_TIER
    share = F.least(F.lit(1.0), F.lit(0.70) + (F.col("matched") - 1) * F.lit(0.15))
    return (
        counted.withColumns({
            "tier": pick(lambda i: _quoted(tiers[i][0]), _quoted(unknown[0])),
            "weight": pick(lambda i: f"{tiers[i][1]}D", f"{unknown[1]}D"),
            "label": pick(lambda i: _quoted(tiers[i][2]), _quoted(unknown[2])),
            "matched": pick(lambda i: f"_n{i}", "0")})
        .withColumn("confidence", F.when(F.col("matched") == 0, F.lit(0.0)).otherwise(
            F.round(share.cast("decimal(10,4)"), 2).cast("double")))
        .drop(*[f"_n{i}" for i in range(len(tiers))])
    )


def tier_code(tier: Column) -> Column:
    """1..8 code of a tier for the feature matrix."""
    out = F.lit(D.UNKNOWN_TIER[3])
    for name, _, _, code, _ in D.TIERS:
        out = F.when(tier == name, F.lit(code)).otherwise(out)
    return out


def tier_weight(tier: Column) -> Column:
    out = F.lit(D.UNKNOWN_TIER[1])
    for name, weight, _, _, _ in D.TIERS:
        out = F.when(tier == name, F.lit(weight)).otherwise(out)
    return out


def file_category(file_name: Column) -> Column:
    low = F.lower(file_name)
    out = F.lit(D.FILE_UNCATEGORISED)
    for label, words in reversed(D.FILE_CATEGORIES):
        out = F.when(low.rlike("|".join(words)), F.lit(label)).otherwise(out)
    return out


def file_stem(file_name: Column) -> Column:
    return F.regexp_replace(file_name, r"(?<=.)\.[^.]*$", "")


def file_meaningless(file_name: Column) -> Column:
    """No category, and a generic word, a stem of up to three characters or digits only."""
    stem = file_stem(file_name)
    vague = (contains_any(F.lower(file_name), D.GENERIC_FILE_WORDS)
             | (F.length(stem) <= 3) | stem.rlike("^[0-9]+$"))
    return (file_category(file_name) == D.FILE_UNCATEGORISED) & vague


def split_list(text: Column) -> Column:
    """', '-joined list -> trimmed array."""
    return F.transform(F.split(text, ","), F.trim)


def message_normalise(text: Column) -> Column:
    """Lower case, single blanks, and the first number of a range '4 - 5'."""
    low = F.regexp_replace(F.trim(F.lower(F.coalesce(text, F.lit("")))), r"\s+", " ")
    return F.regexp_replace(low, r"([0-9])\s*-\s*([0-9])", "$1")


def chat_intent(text: Column) -> Column:
    """0..10 keyword score of the joined chat text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return chat_intent_from_hits(
        keyword_count(low, D.HIGH_INTENT_WORDS), keyword_count(low, D.MEDIUM_INTENT_WORDS),
        low.rlike("0[3-9][0-9]{8}"), low.rlike(r"[0-9]+\s*(tỷ|triệu|(tr|ty)([^\p{L}\p{N}_]|$))"))


def chat_intent_from_hits(high: Column, medium: Column, phone: Column, amount: Column) -> Column:
    score = (F.least(F.lit(6.0), high * F.lit(1.5)) + F.least(F.lit(3.0), medium * F.lit(0.5))
             + F.when(phone, F.lit(1.5)).otherwise(F.lit(0.0))
             + F.when(amount, F.lit(0.5)).otherwise(F.lit(0.0)))
    return F.round(F.least(score, F.lit(10.0)).cast("decimal(10,4)"), 2).cast("double")


def ad_of_thread(thread_key: Column) -> Column:
    """Part after the last 'ad_' up to the next underscore; null without one."""
    tail = F.substring_index(thread_key, "ad_", -1)
    return F.when(thread_key.contains("ad_"), F.substring_index(tail, "_", 1))


def chat_phone(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(text), "0[3-9][0-9]{8}", 0), F.lit(""))


def chat_email(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(text), r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_]+", 0),
                    F.lit(""))


# --- searching many patterns ------------------------------------------------
def _needed(nodes) -> list[str] | None:
    """Strings of which every match of these parsed parts holds one; None where no such list is known.

    Of the parts' own lists the one with the longest shortest string is taken.
    """
    lists, run = [], ""
    for op, value in [*nodes, (None, None)]:
        if op is _regex.LITERAL:
            run += chr(value)
            continue
        if run:
            lists.append([run])
            run = ""
        inside = None
        if op is _regex.SUBPATTERN and not value[1] and not value[2]:
            inside = _needed(value[3])
        elif op in (_regex.MAX_REPEAT, _regex.MIN_REPEAT) and value[0]:
            inside = _needed(value[2])
        elif op is _regex.BRANCH:
            ways = [_needed(way) for way in value[1]]
            inside = None if None in ways else list(dict.fromkeys(x for way in ways for x in way))
        if inside:
            lists.append(inside)
    return max(lists, key=lambda x: (min(map(len, x)), -len(x)), default=None)


def needed_literals(pattern: str) -> list[str]:
    """Literal strings of which every match of ``pattern`` holds at least one; empty where none can be told."""
    try:
        parsed = _regex.parse(pattern)
    except re.error:  # Java's own syntax
        return []
    if parsed.state.flags & (re.IGNORECASE | re.VERBOSE):
        return []
    return _needed(parsed) or []


def found(text: Column, pattern: str) -> Column:
    """``rlike`` that searches only texts with one of the literals the pattern needs.

    A byte search for a literal costs a fraction of a regular expression, so of
    many patterns only those that can match are tried.
    """
    literals = needed_literals(pattern)
    if not literals:
        return text.rlike(pattern)
    return contains_any(text, literals) & text.rlike(pattern)

"""License scan against a plain search of every window."""

import random
import re

from leadloom.llm import licenses
from leadloom.llm.queries import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, phrases, templates, percent, slack):
    """The operator's columns, with every window of every template looked at."""
    found, places, base, blocks = plain_words(text), [], set(), []
    for label, phrase in phrases:
        p = plain_words(phrase)
        for at in range(len(found) - len(p) + 1):
            if found[at:at + len(p)] == p:
                places.append(at)
                base.add(label)
    for k, (label, notice) in enumerate(templates):
        t = plain_words(notice)
        width, runs = -(-len(t) * (100 + slack) // 100), []
        for at, word in enumerate(found):  # the first word of a window is one of the template's
            if word not in t:
                continue
            held = len(set(found[at:at + width]) & set(t))
            if 100 * held >= percent * len(set(t)):
                end = min(at + width, len(found))
                if runs and at < runs[-1][1]:
                    runs[-1] = (runs[-1][0], end, max(runs[-1][2], held))
                else:
                    runs.append((at, end, held))
        blocks += [(label, k, a, b - a, held / len(set(t))) for a, b, held in runs]
    score = 1.0 if base else max((b[4] for b in blocks), default=0.0)
    return (len(found), len(places), min(places, default=None), max(places, default=None), sorted(base),
            sorted(base | {b[0] for b in blocks}), score, sorted(blocks, key=lambda b: (b[2], b[1])))


def rows_of(df):
    return sorted((r["doc_id"] is None, r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"],
                   r["score"], [tuple(b) for b in r["blocks"]]) for r in df.collect())


def check(docs, pairs, **options):
    got = rows_of(licenses.scan(docs, **options))
    p, t = options.get("phrases", licenses.PHRASES), options.get("templates", licenses.TEMPLATES)
    want = sorted((i is None, i, *brute(x, p, t, options.get("percent", 90), options.get("slack", 25))) for i, x in pairs)
    assert got == want


def test_odd_rows(docs, odd_rows):
    notice = licenses.TEMPLATES[1][1]
    pairs = [*odd_rows, (20, "x " * 300 + notice + " y" * 50), (21, notice.replace("charge", "cost")), (22, "cc by nc " * 40),
             (23, "Released under the\n MIT License. Released under the MIT License."), (23, "the the mit mit license under released"),
             (24, notice.replace("free", "").replace("grants", "").replace("deal", "").replace("person", ""))]
    check(docs(pairs), pairs)


def test_random_windows(docs):
    """Few words in many orders: windows at and around the threshold, overlapping blocks, ends of texts."""
    r = random.Random(5)
    pairs = [(i, " ".join(r.choice("abcdefghxyz") for _ in range(r.randrange(60)))) for i in range(300)]
    templates = [("one", "a b c d"), ("two", "a a e f g h b"), ("none", "..."), ("long", "a b c d e f g h q"), ("one", "h g")]
    for percent in (60, 90):
        check(docs(pairs), pairs, phrases=[("p", "a b"), ("q", "x x"), ("p", "c")], templates=templates, percent=percent, slack=30)


def test_empty_table_and_added_names(spark, docs):
    assert licenses.scan(docs([])).collect() == []
    out = licenses.scan(docs([(1, "x")]))
    assert out.columns[-len(licenses.FIELDS):] == [f.name for f in licenses.FIELDS] and out.first()["n_words"] == 1


def test_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    check(docs, [tuple(r) for r in docs.collect()])

import re

from sievewright.llm import decontam

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(t):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items):
    w = words(text)
    hit, who = [False] * len(w), set()
    for item, t in items:
        iw = words(t)
        n = min(13, len(iw))
        if item is None or not n:
            continue
        for k in range(len(iw) - n + 1):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == iw[k : k + n]:
                    who.add(str(item))
                    hit[p : p + n] = [True] * n
    return len(w), sum(hit), sorted(who)


def test_against_brute_force(spark):
    import random

    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(40)] + ["Äpfel", "ÉTÉ", "x9"]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, prose(rng.randint(13, 40))) for i in range(12)] + [(50, "only five words of item"), (51, "Äpfel"), (52, ""), (53, None), (None, prose(20)), (54, "again again " * 10), (55, "again again " * 10)]
    docs = [None, "", "...", prose(300), "Äpfel", "AGAIN again " * 9, "again " * 40]
    for _, t in items[:12]:
        docs.append(prose(20) + ",. " + t.upper() + " " + prose(15))
        docs.append(prose(3) + " " + " ".join(t.split()[1:12]))
        docs.append(" ".join(t.split()[:13]) + "-" + prose(5))
    docs.append(prose(30000) + " " + items[3][1] + " " + prose(100) + " five only five words of item")
    rows = [(i, t, "x") for i, t in enumerate(docs)] + [(3, docs[3], "x"), (None, docs[8], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_ids string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(i, *brute(t, items)) for i, t, _ in rows], key=repr)
    for bits in (26, 6):  # a filter that few pass, one that most pass
        got = decontam.contaminated_words(df, bench, filter_bits=bits).collect()
        assert sorted([(r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got], key=repr) == want


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    (row,) = decontam.contaminated_words(docs, none).collect()
    assert (row.n_words, row.n_hit, row.item_ids) == (2, 0, [])
    assert decontam.contaminated_words(docs.limit(0), none).collect() == []


def test_copies_and_frequent_windows(spark):
    """A text in a third of the rows, a passage that all items share, an item of one frequent word."""
    shared = " ".join(f"s{i}" for i in range(15))
    items = [(i, f"{shared} q{i} " + " ".join(f"u{i}x{k}" for k in range(13))) for i in range(60)] + [(99, "the")]
    hot = f"a b {shared} c d the the"
    docs = [(i, hot) for i in range(200)] + [(i, f"the {shared} q{i % 60} the t{i}") for i in range(200, 300)] + [(i, None if i % 2 else f"no {i}") for i in range(300, 400)]
    got = decontam.contaminated_words(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(7).selectExpr("*", "text as k", "doc_id as n_hit_"),
        spark.createDataFrame(items, "item_id long, text string").repartition(3),
        keep=("text", "k"),
    ).collect()
    want = {t: brute(t, items) for t in {t for _, t in docs}}
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n_hit, r.item_ids) == want[r.text] and r.k == r.text
        assert sum(s.length for s in r.hit_spans) == r.n_hit

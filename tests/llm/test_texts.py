"""Formatting copies, leaked items, mixtures and abuse on small texts."""

import random

import pytest
from pyspark.sql import functions as F

from skein.llm.abuse import CharModel, _grams, char_model, frequent_words, restored_words, scored_documents, word_counts
from skein.llm.copies import canonical_address, formatting_copies
from skein.llm.leaks import fingerprints, leaked_items, window_size
from skein.llm.mixing import mixture_report, mixture_schedule, source_name


def test_copies(spark):
    rows = [
        ("n1", "http://a.b/x-y/z?q=1&r=2#Top"), ("n2", "HTTP://A.B/x_y//z/?r=2&&q=1#top"), ("n3", "http://a.b/%78y/z?q=1&r=2#top"), ("n1", "http://a.b/x-y/z?q=1&r=2#Top"),
        ("n4", "http://a.b/other"), ("n5", None), (None, "http://a.b/other"), ("n6", "http://a.b/50%"), ("n7", " http://a.b/50% \r\n"), ("n8", ""), ("n9", "http://a.b/xy/z?q=2&r=1#top"),
    ]
    df = spark.createDataFrame(rows, "node_id string, url string").withColumn("raw", F.lit(1)).withColumn("n", F.lit("x"))
    assert {tuple(r) for r in formatting_copies(df).collect()} == {("n1", "n1", 3), ("n1", "n2", 3), ("n1", "n3", 3), ("n6", "n6", 2), ("n6", "n7", 2)}
    assert formatting_copies(df.limit(0)).count() == 0
    assert spark.createDataFrame([(None,)], "u string").select(canonical_address(F.col("u"))).first()[0] is None


def test_leaks_against_brute_force(spark):
    random.seed(2)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(random.choice(words) for _ in range(random.choice((5, 13, 40))))) for k in range(12)] + [(98, None), (99, "")]
    docs = []
    for k in range(80):
        t = [random.choice(words) for _ in range(random.choice((3, 30, 120)))]
        if k % 3 == 0:
            q = items[k % 12][1].split()
            lo = random.randrange(max(1, len(q) - 12))
            t[5:5] = q[lo : lo + random.choice((11, 12, 13, 20))]
        docs.append((k, "  ".join(t).upper() if k % 2 else ", ".join(t)))
    docs += [(200, None), (201, ""), docs[0]]

    def held(text, q):
        a, b = text.lower().replace(",", " ").split(), q.split()
        runs = {tuple(a[i : i + 13]) for i in range(len(a) - 12)}
        return any(tuple(b[i : i + 13]) in runs for i in range(len(b) - 12))

    want = {(d, i) for d, t in docs for i, q in items if t and q and held(t, q)}
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, question string")
    assert want and {tuple(r) for r in leaked_items(df, it).collect()} == want
    assert {tuple(r) for r in leaked_items(df, it, indexed_words=60, radius=3).collect()} == want
    assert leaked_items(df.limit(0), it).count() == 0 and leaked_items(df, it.limit(0)).count() == 0


def test_edited_items(spark):
    """Windows of whole items find edited copies that no 13 equal words betray; the radius decides how many."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(14, 60)))) for k in range(60)] + [(98, None), (99, "too short")]
    docs, edited = [], {}
    for k in range(240):
        q = items[k % 60][1].split()
        for at in range(rng.randrange(5, 11), len(q), 24):
            q[at] = rng.choice(words)
        t = [rng.choice(words) for _ in range(60)]
        t[30:30] = q
        docs.append((k, " ".join(t)))
        edited[k] = q

    def share(text, q):  # of the item's five-word runs, weighted by their rarity (here all the same)
        a, b = text.split(), q.split()
        runs = {tuple(a[i : i + 5]) for i in range(len(a) - 4)}
        mine = [tuple(b[i : i + 5]) for i in range(len(b) - 4)]
        return sum(x in runs for x in mine) / len(mine)

    want = {(k, k % 60) for k, t in docs if share(t, items[k % 60][1]) >= 0.7}
    df, it = spark.createDataFrame([*docs, (900, None), (901, "")], "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, question string")
    found = {r: {tuple(x) for x in leaked_items(df, it, size=None, radius=r, similarity=0.7).collect()} for r in (0, 10)}
    exact = {tuple(x) for x in leaked_items(df, it).collect()}
    assert found[10] <= want and len(found[10]) >= 0.9 * len(want) > 50 and len(found[0]) < 0.5 * len(want)
    assert len(found[10] - exact) > 5
    assert {tuple(x) for x in leaked_items(df, it, size=None, radius=10, similarity=0.7, indexed_words=500).collect()} >= {p for p in found[10] if share(docs[p[0]][1], items[p[1]][1]) > 0.75}
    assert leaked_items(df.limit(0), it, size=None).count() == 0 and leaked_items(df, it.limit(0), size=None).count() == 0


def test_window_sizes():
    assert [window_size(n) for n in (5, 6, 7, 9, 40, 84)] == [5, 6, 7, 8, 33, 78]


def test_fingerprints_are_majorities():
    import numpy as np

    w = np.random.default_rng(1).integers(0, 2**63, 40).astype(np.uint64)
    got = fingerprints(w, 13)
    for i in (0, 9, 27):
        bits = sum(((int(x) >> np.arange(64).astype(object)) & 1 for x in w[i : i + 13]), start=np.zeros(64, object))
        assert int(got[i]) == sum(1 << b for b in range(64) if bits[b] * 2 > 13)


def corpus(spark):
    rows = [(k, f"some words of document {k} " * (1 + k % 5), ["Article", "article ", "for-um", None][k % 4]) for k in range(200)] + [(900, None, "article"), (901, "", "forum")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source_name string, target_share double, max_repeats int, size_factor double")


def test_mixture(spark):
    docs = corpus(spark)
    t = targets(spark, [("article", 0.5, 1, 0.5), ("for_um", 0.4, 2, 0.9), ("nothing", 0.1, 3, 0.5), (None, 0.1, 1, 1.0)])
    r = {x["source_name"]: x for x in mixture_report(docs, t).collect()}
    assert set(r) == {"article", "for_um", "nothing"} and r["nothing"]["tokens_used"] == 0
    assert abs(r["article"]["tokens_used"] - r["article"]["tokens_wanted"]) <= 60 and r["article"]["repeats"] == 1
    assert r["for_um"]["repeats"] == 2 and r["for_um"]["tokens_used"] <= 2 * r["for_um"]["tokens_available"] and abs(sum(x["actual_share"] for x in r.values()) - 1) < 1e-9
    r = {x["source_name"]: x for x in mixture_report(docs, t, block_tokens=200).collect()}
    plan = mixture_schedule(docs, t, block_tokens=200).collect()
    assert len(plan) == sum(x["uses"] for x in r.values()) and len({(x["doc_id"], x["pass_no"]) for x in plan}) == len(plan) and all(x["slot_no"] is not None for x in plan)
    counted = {}
    for x in plan:
        counted[x["source_name"]] = counted.get(x["source_name"], 0) + x["n_tokens"]
    assert counted == {k: x["tokens_used"] for k, x in r.items() if x["tokens_used"]}
    order = [s for _, s in sorted({(x["slot_no"], x["source_name"]) for x in plan})]
    half = order[: len(order) // 2]
    assert abs(half.count("article") - order.count("article") / 2) <= 2
    assert mixture_report(docs.limit(0), t).agg(F.sum("tokens_used")).first()[0] == 0 and mixture_report(docs, t.limit(0)).count() == 0
    assert spark.createDataFrame([(" Crawl-Report ",), ("",)], "s string").select(source_name(F.col("s"))).collect()[0][0] == "crawl_report"


@pytest.fixture(scope="module")
def chars():
    counts: dict[str, int] = {}
    for w, n in {"idiot": 50, "moron": 30, "harbour": 80, "vermin": 40, "stable": 60, "мерзотник": 30, "pathetic": 20, "hello": 90, "bridge": 50}.items():
        for g in _grams(w):
            counts[g] = counts.get(g, 0) + n
    return CharModel(counts)


def test_restoring(chars):
    words = lambda t: restored_words(t, chars, {})
    assert words("1d10t m0r0n verm*n мерзо*ник") == ["idiot", "moron", "vermin", "мерзотник"]
    assert words("i d i o t v-e-r-m-i-n idiiiiot id​iot іdіоt") == ["idiot", "vermin", "idiot", "idiot", "idiot"]
    assert words("the 1453 bridge hello") == ["the", "bridge", "hello"] and words("") == []


def test_scores(spark):
    good = ["The harbour kept {} boats away.", "Each bridge in town has {} lamps.", "Rule {} forbids words such as idiot in posts.", "Visitors of the mill find {} stones."]
    bad = ["You are a pathetic idiot and nobody wants you here {}.", "All of them are vermin and should be driven out {}.", "Shut up you pathetic piece of trash {}."]
    random.seed(4)
    rows, labels = [], []
    for k in range(300):
        parts = [random.choice(good).format(random.randrange(9999)) for _ in range(4)]
        is_bad = k % 6 == 0
        if is_bad:
            parts[random.randrange(4)] = random.choice(bad).format(k)
        rows.append((k, " ".join(parts)))
        if k < 220:
            labels.append((k, "abusive" if is_bad else "clean"))
    rows += [(900, None), (901, ""), (902, "You are a p@thetic 1d1ot and nobody wants you here."), (903, "word " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("flagged", F.lit("other"))
    got = {r["doc_id"]: r for r in scored_documents(df.drop("flagged"), spark.createDataFrame(labels + [(1, None), (None, "clean")], "doc_id bigint, verdict string")).collect()}
    held_out = [k for k in range(220, 300)]
    assert sum(got[k]["flagged"] == (k % 6 == 0) for k in held_out) >= 0.95 * len(held_out)
    assert got[902]["flagged"] and got[900]["score"] == -20.0 and not got[901]["flagged"] and not got[903]["flagged"]
    none = scored_documents(df.drop("flagged"), spark.createDataFrame([], "doc_id bigint, verdict string"))
    assert none.count() == len(rows) and scored_documents(df.drop("flagged").limit(0), spark.createDataFrame(labels, "doc_id bigint, verdict string")).count() == 0


def test_frequent_disguises_are_restored(spark):
    plain = "the harbour bridge is stable and the little idiot was naked here "
    docs = spark.range(1040).select(F.when(F.col("id") < 1000, F.concat(F.repeat(F.lit(plain), 130), F.lit("nаkеd idiiiot xxx"))).otherwise("iddiot").alias("text"))
    words = word_counts(docs)
    known = frequent_words(words)
    assert known >= {"the", "little", "naked", "xxx"} and not known & {"nаkеd", "idiiiot", "iddiot"}
    assert restored_words("nаkеd idiiiot iddiot little", char_model(words), {}, known) == ["naked", "idiot", "idiot", "little"]


def test_many_targets(spark, monkeypatch):
    """Any number of wanted sources, with and without broadcast, and small blocks that all find a slot."""
    from skein.llm import mixing

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id")).alias("text"), F.concat(F.lit("s"), F.pmod("id", F.lit(700))).alias("source"))
    wanted = targets(spark, [(f"s{k}", 1 / 800, 2, 1.0) for k in range(800)])
    once = {tuple(r) for r in mixture_report(docs, wanted, block_tokens=3, words=True).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_USES", 0)
    assert {tuple(r) for r in mixture_report(docs, wanted, block_tokens=3, words=True).collect()} == once and len(once) == 800
    used = {r["source_name"]: r["tokens_used"] for r in mixture_report(docs, wanted, block_tokens=3, words=True).collect()}
    assert all(abs(used[f"s{k}"] - 6000 / 800) <= 2 for k in range(700)) and used["s750"] == 0

"""Main bodies, residue and alike pages on small pages and against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from skein.llm import alike, pagejobs
from skein.llm.alike import gaps, ungaps
from skein.llm.blocks import visible_blocks
from skein.llm.pagejobs import alike_page_classes, alike_pages, block_model, body_blocks, residue_pages
from skein.llm.pages import ACROSS, SEGMENT, WITHIN, cut_labels, describe, fit_blocks, main_body, minimum_cut, smoothness, weak_labels
from skein.llm.residue import has_phrase, has_slots, is_lorem, is_repetition, judge, masked

SCHEMA = "response_id bigint, url string, html string, status_code int"
SENTENCES = [f"The {a} near {b} kept {n} {c} away from the {d} before the long winter." for a, b, n, c, d in [("harbour", "Vela", 12, "boats", "tower"), ("garden", "Toro", 7, "stones", "mill"), ("museum", "Kade", 91, "letters", "bridge"), ("tunnel", "Luma", 4, "lamps", "school"), ("market", "Zola", 33, "wheels", "canal"), ("station", "Rova", 58, "tickets", "ferry")]]


def page(body, title="Quiet harbour"):
    return f"""<html><head><title>x</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/b">Books</a></li></ul></nav>
<div class="crumbs"><a href="/">Home</a> › {title}</div><div class="c1"><h1>{title}</h1>{body}</div><div role="dialog"><p>We use cookies to make this site work better. Accept all.</p></div>
<section class="related"><h3>Most read</h3><li><a href="/1">Other page one</a></li></section><footer><p>© 2024 Site. All rights reserved.</p><p>{SENTENCES[5]}</p></footer></body></html>"""


NOUNS = "boat stone letter lamp wheel ticket pond roof chair barrel ladder kettle fence plough anchor candle saddle basket oven rope".split()


def prose(rng, n=14):
    return "The " + " ".join(rng.choice(NOUNS) + rng.choice(["", "s"]) for _ in range(n)) + f" {rng.randrange(999)} stayed."


def corpus(sites=4, pages=14, seed=5):
    """Pages of a few sites with a template each: navigation, crumbs, consent, pointers, footer."""
    rng, out = random.Random(seed), []
    for s in range(sites):
        menu = rng.sample(NOUNS, 5)
        for k in range(pages):
            title = prose(rng, 3)
            items = "".join(f"<li>{prose(rng, 3)}</li>" for _ in range(3))
            main = f"<p>{prose(rng)}</p><div>Advertisement</div><p>{prose(rng)}</p><h2>{prose(rng, 2)}</h2><ul>{items}</ul><div class='x'>Read also: <a href='/q'>{prose(rng, 3)}</a></div><p>{prose(rng)}</p>"
            links = "".join(f"<li><a href='/{m}'>{m}</a></li>" for m in menu)
            related = "".join(f"<li><a href='/r{rng.random()}'>{prose(rng, 3)}</a></li>" for _ in range(3))
            html = f"<html><body><nav><ul><li><a href='/'>Home</a></li>{links}</ul></nav><div class='crumbs'><a href='/'>Home</a> › {title}</div><div class='c1'><h1>{title}</h1>{main}</div><div role='dialog'><p>We use cookies to make this site work better. Accept all.</p></div><section class='related'><h3>Most read</h3>{related}</section><footer><p>© 2024 Site {s}. All rights reserved.</p><p>{SENTENCES[5]}</p></footer></body></html>"
            out.append((f"site{s}", html))
    return out


@pytest.fixture(scope="module")
def model():
    return fit_blocks(corpus())


def test_main_body_of_a_page(model):
    body = f"<p>{SENTENCES[0]}</p><div>Advertisement</div><!-- {SENTENCES[4]} --><p>{SENTENCES[1]} <b>Bold</b>&amp;<br/>more</p><ul><li>One thing</li><li>Another thing</li></ul><div class='x'>Read also: <a href='/q'>Something else</a></div><p>{SENTENCES[2]}</p><pre>code  here</pre><p>{SENTENCES[3]}</p>"
    texts, listing = main_body(page(body), model)
    assert texts == ["Quiet harbour", SENTENCES[0], SENTENCES[1] + " Bold& more", "One thing", "Another thing", SENTENCES[2], "code here", SENTENCES[3]]
    assert listing == [False] * 6 + [True, False]


def test_cut_decides_by_segment():
    """What the classifier leaves open goes with its segment; what it is sure of stays."""
    segments = [1, 2, 3, 3, 3, 3, 4, 5, 5, 5]
    score = [6.0, 4.0, -6.0, 0.8, 0.8, 0.8, 5.0, 6.0, -0.8, 0.5]
    labels = minimum_cut(score, smoothness(segments))
    assert [s > 0 for s in score] != labels == [True, True, False, False, False, False, True, True, True, True]
    assert WITHIN > SEGMENT > ACROSS > 0


def test_weak_labels():
    pages = []
    for site, html in corpus():
        blocks = visible_blocks(html)
        pages.append((site, blocks, *describe(blocks)))
    labels = weak_labels(pages)
    said = {b.text.split()[0]: y for b, y in zip(pages[0][1], labels[0])}
    assert said["Home"] == said["Advertisement"] == said["We"] == said["Read"] == said["Most"] == 0
    assert [y for b, y in zip(pages[0][1], labels[0]) if b.chain[-1][1] in ("h1", "h2")] == [1, 1]


def test_broken_pages(model):
    assert main_body("", model) == ([], []) and main_body("plain text without tags at all, yet a sentence.", model)[0]
    assert main_body(f"<html><body><div><p>{SENTENCES[0]} Cut off in the mid", model)[0] == [SENTENCES[0] + " Cut off in the mid"]
    assert main_body(f"<body><h1>A</h1><p>{SENTENCES[0]}<p>{SENTENCES[1]}</div><a hre", model)[0] == ["A", SENTENCES[0], SENTENCES[1]]
    long = "<h1>T</h1>" + "".join(f"<p>{SENTENCES[k % 6]} {k}</p>" for k in range(3000))
    assert len(main_body(f"<body>{long}</body>", model)[0]) == 3001
    nothing = fit_blocks([])
    assert main_body(f"<body><h1>A</h1><p>{SENTENCES[0]}</p></body>", nothing)[0] == ["A", SENTENCES[0]] and fit_blocks([("s", "")]).bias == 0.0


def test_minimum_cut_is_minimal():
    random.seed(3)
    for _ in range(60):
        n = random.randint(1, 9)
        score = [random.uniform(-3, 3) for _ in range(n)]
        edges = {(i, j): random.uniform(0, 2) for i in range(n) for j in range(i + 1, n) if random.random() < 0.4}
        cost = lambda lab: sum((-s if not x else 0) if s < 0 and False else (max(s, 0) if not x else max(-s, 0)) for s, x in zip(score, lab)) + sum(w for (i, j), w in edges.items() if lab[i] != lab[j])
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(2**n))
        assert abs(cost(minimum_cut(score, edges)) - best) < 1e-6


def test_residue_rules():
    assert masked("Error 404.") == "error #" and masked("See http://a.b/c on 2024-01-02!") == "see @ on #"
    known = ("Page not found", "Error 503", "Seite nicht gefunden", "Página no encontrada", "Сторінку не знайдено", "Please enable JavaScript to view this page.", "Your text goes here.", "Coming soon…", "403 Forbidden", "text text text text", "asdf asdf qwer asdf")
    unlisted = ("This site can't be reached", "Just a moment...", "Whoops, looks like something went wrong.", "Seite wurde nicht gefunden", "Sample text", "Your description goes here")
    for t in known + unlisted:
        assert has_phrase(t.lower()) and judge([t], False)[0] == "message", t
        assert judge([t, *SENTENCES], False) == (None, [masked(t)]), t
    for t in ("Hello {{ name }}", "from #{city} to", "<%= title %>", "%%title%% x", "__summary__", "[object Object] came", "waited null null days", "undefined recent chapel", "[[date]] x", "@Model.price"):
        assert has_slots([t]) and judge([t], False)[0] == "slot", t
    for t in ("I have None left", "The $HOME variable", "What does undefined mean here?", "__ x snake_case", "50% of 100 costs $5", "Nobody knows", "[1] note", "None of them came.", ""):
        assert not has_slots([t]), t
    assert has_slots(["it took null days", "for NaN boats"]) and has_slots(["$TITLE and $NAME"]) and not has_slots(["None came", "None left"])
    assert is_lorem("lorem ipsum dolor sit amet, consectetur adipiscing elit.") and not is_lorem("the old habit of filling a draft with lorem ipsum hides mistakes.")
    assert is_repetition("text text text") and not is_repetition("he said that he knew") and not is_repetition("")


def background(first=1000):
    """Pages of other sites, on which the block classifier is fitted."""
    return [(first + k, f"http://{site}.x/{k}", html, 200) for k, (site, html) in enumerate(corpus())]


def test_page_queries(spark):
    rows = [
        (1, "http://a/1", page(f"<p>{SENTENCES[0]}</p>"), 200), (1, "http://a/1", page(f"<p>{SENTENCES[0]}</p>"), 200),
        (2, "http://a/2", page("<p>Please enable JavaScript to view this page.</p>", "Oops"), 200), (3, "http://a/3", None, 500),
        (4, "http://a/4", page(f"<p>{SENTENCES[1]}</p><pre>&lt;h1&gt;{{{{ title }}}}&lt;/h1&gt;</pre><noscript>Please enable JavaScript to view this page.</noscript>"), 404),
        (5, None, "<body><div id='root'></div><noscript>JavaScript is disabled in your browser.</noscript></body>", 200), (6, "http://a/6", "", 200), (None, "http://a/7", "<p>x</p>", 200),
    ]
    df = spark.createDataFrame(rows + background(), SCHEMA)
    assert {r[0] for r in residue_pages(df).collect()} == {2, 5}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    want = {(1, md5("Quiet harbour")), (1, md5(SENTENCES[0])), (4, md5("Quiet harbour")), (4, md5(SENTENCES[1])), (4, md5("<h1>{{ title }}</h1>"))}
    got = [tuple(r) for r in body_blocks(df).where("response_id < 1000").collect()]
    assert set(got) == want and len(got) == 5
    for f in (body_blocks, residue_pages, alike_pages, alike_page_classes):
        assert f(df.limit(0)).count() == 0


def test_alike_against_brute_force(spark):
    random.seed(11)
    words = [f"w{k}" for k in range(400)]
    base = [[random.choice(words) for _ in range(random.choice((30, 80, 200)))] for _ in range(25)]
    texts = []
    for b in base:
        texts.append(b)
        for _ in range(random.randrange(4)):
            c = b[:]
            for _ in range(random.randrange(1 + len(c) // 9)):
                c[random.randrange(len(c))] = random.choice(words)
            texts.append(c)
    texts += [texts[0]] * 6 + [["one", "two"], ["one", "two"]]
    rows = [(k, f"http://s{k % 3}/{k}", page("<p>" + " ".join(t) + ".</p>", "Same old title"), 200) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:2] + background(), SCHEMA).withColumn("n", F.lit(1)).withColumn("ck", F.lit("x"))
    fitted, sets = block_model(df), []
    for _, _, html, _ in rows:
        w = re.findall(r"[^\W_]+", " ".join(main_body(html, fitted)[0]).lower())
        sets.append(set(zip(w, w[1:], w[2:])))
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b]) > 0}
    assert {tuple(r) for r in alike_pages(df).where("response_id_a < 1000").collect()} == want
    classes = {r["response_id"]: r for r in alike_page_classes(df).collect()}
    assert classes[0]["n_members"] == sum(s == sets[0] for s in sets) >= 7 and classes[len(texts) - 3]["class_id"] == 0


def test_hot_classes_and_large_sides(spark, monkeypatch):
    """A class of many members is joined in parts; lists beyond the broadcast bound are joined plainly."""
    df = spark.createDataFrame([(k, f"http://a/{k}", page(f"<p>{SENTENCES[k // 12]}</p>"), 200) for k in range(24)] + background(), SCHEMA)
    want = {tuple(r) for r in alike_pages(df).collect()}
    assert sum(b < 24 for _, b in want) == 2 * 66
    monkeypatch.setattr(pagejobs, "MEMBERS_PER_PART", 3)
    monkeypatch.setattr(pagejobs, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(alike, "BROADCAST_CLASSES", 0)
    monkeypatch.setattr(alike, "REGION_ENTRIES", 50)
    assert {tuple(r) for r in alike_pages(df).collect()} == want
    assert {r["n_members"] for r in alike_page_classes(df).where("response_id < 24").collect()} == {12}


def test_gaps():
    import numpy as np

    for x in ([5], [0, 0, 3, 257, 258, 600, 2**40], [7, 7 + 254, 7 + 254 + 255]):
        assert ungaps(gaps(np.array(x, np.int64))).tolist() == x


def test_recurring_messages(spark):
    """What is within a body is a message if it recurs with other text around it, what is written about messages is none."""
    fault = "Your request was not served because the inner part of this machine reported an error that nobody expected; " + "we ask all visitors to wait a little and to come back in the evening when our people have looked after it; " * 3
    rng = random.Random(8)
    about = "The sign at the gate says access denied, yet {} boats went through it to {}."
    body = lambda t: page(f"<p>{prose(rng)}</p><p>{t}</p><p>{prose(rng)}</p><p>{prose(rng)}</p><p>{prose(rng)}</p>", prose(rng, 4))
    same = page(f"<p>{SENTENCES[0]}</p><p>{about.format(7, 'Sesto')}</p><p>{SENTENCES[1]}</p><p>{SENTENCES[2]}</p>")
    trace = "Traceback (most recent call last): " + " ".join(f'File "/srv/app/part{k}.py", line {k}, in run_{k} return self.call(request)' for k in range(9))
    assert len(trace) > 300 and len(fault) > 300
    rows = [(10 + k, f"http://s{k}/x", body(fault), 200) for k in range(4)] + [(20 + k, f"http://s{k}/y", body(about.format(k, NOUNS[k])), 200) for k in range(4)]
    rows += [(30 + k, f"http://s{k}/z", same, 200) for k in range(4)] + [(40, "http://s9/w", body("Whoops, looks like something went wrong."), 200)]
    rows += [(50 + k, f"http://s{k}/t", f"<html><body><p>{trace}</p></body></html>", 500) for k in range(3)]
    rows += [(60 + k, f"http://s{k}/v", body("Whoops, looks like something went wrong."), 200) for k in range(3)]
    assert {r[0] for r in residue_pages(spark.createDataFrame(rows + background(), SCHEMA)).collect()} == {*range(10, 14), 40, *range(50, 53), *range(60, 63)}

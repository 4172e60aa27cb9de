"""HTML extraction and the quality classifier."""

import random

import numpy as np
from loomgraph.llm import classifier, html_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
<article><h1>Head &amp; &quot;more</h1><p>First <b>bold</b>   text.<br>Same block<p>Second<ul><li>one<li>two</ul>
<aside>side</aside><form><p>in form</p></form><div class="comments"><p>reader</p></div></article>
<div class="ad">Buy</div><footer>foot</footer></body></html>"""


def text_of(html):
    return html_text._main_text(html, None)


def test_stray_quotes_in_tags_hide_no_text():
    for html, expected in (
        ("<article><p it's>one</p><p>two</p><p it's>three</p></article>", ["one", "two", "three"]),
        ("<article><p>a<img alt=it's>b</p><p>c<img alt=it's></p></article>", ["ab", "c"]),
        ("<article><p title='x > y'>one</p><p title = \"a>b\">two</p></article>", ["one", "two"]),
    ):
        assert html_text.page_lines(html)[0] == expected


def test_a_menu_or_notice_that_an_article_is_about_stays():
    dishes = "<p>soup of the day</p><p>roast with dumplings</p>"
    for name in ("menu", "notice", "menu-list"):
        assert len(html_text.page_lines(f'<article><h1>Lunch</h1><div class="{name}">{dishes}</div></article>')[0]) == 3
        assert html_text.page_lines(f'<article><p>{"a long story " * 9}</p><div class="{name}">home</div></article>')[0] == [("a long story " * 9).strip()]
        assert html_text.page_lines(f'<div class="{name}">{dishes}</div><article>x</article>')[0] == ["x"]
    assert html_text.page_lines(f'<article><p>short</p><div class="comments">{dishes}</div></article>')[0] == ["short"]


def test_structure():
    assert text_of(PAGE) == 'Head & "more\nFirst bold text. Same block\nSecond\none\ntwo'
    assert text_of(None) == text_of("") == text_of("<p>") == text_of("<script>x") == ""
    assert text_of("plain &lt;text&gt;\n here") == "plain <text> here"
    assert text_of("<article><p>cut off <b>here") == "cut off here"
    assert text_of('<p title="a>b">x</p><p class=\'Ad\'>y</p>') == "x"


def test_names_that_only_mention_a_region_keep_the_article():
    for html in (
        '<main class="has-sidebar"><p>body</p></main>',
        '<div class="layout with-sidebar"><article><p>body</p></article></div>',
        '<article class="post share-enabled comments-open"><p>body</p></article>',
        '<div class="sidebar"><main><p>body</p></main></div>',
        '<div class="content-sidebar-wrap"><p>body</p></div>',
        '<article><div class="related-work"><p>body</p></div></article>',
        '<body class="ad"><p>body</p></body>',
    ):
        assert text_of(html) == "body", html
    for html in ("sidebar", "site-footer", "ad-slot", "comment-list", "post Advert", "cookie_notice", "related", "widget-2"):
        assert text_of(f'<article><p>body</p><div class="{html}"><p>no</p></div></article>') == "body", html
    for role in ("navigation", "banner"):
        assert text_of(f'<p>body</p><div role="{role}">no</div>') == "body"


def test_a_teaser_is_not_the_page():
    body = "<p>A long first paragraph of the page.</p><p>And a second one, as long as that.</p>"
    assert text_of(f"<div>{body}</div><article><p>Teaser</p></article>").split("\n")[0] == "A long first paragraph of the page."
    assert text_of(f"<p>x</p><article>{body}</article>").startswith("A long")


def test_very_long_pages():
    many = "".join(f"<p>line {i}</p>" for i in range(60_000))
    assert text_of(f"<article>{many}</article>").count("\n") == 59_999
    assert text_of("<article>" + "<div>" * 3_000 + "deep" + "</div>" * 3_000 + "</article>") == "deep"
    assert len(text_of("<p>" + "word " * 400_000)) == 1_999_999


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(14))] for _ in range(2))
        found = html_text.common_lines(a, b)
        rest = iter(b)
        assert found == sorted(found) and all(a[i] in rest for i in found) and len(found) == longest(a, b)


def test_differencing_against_the_nearest_page(spark):
    page = lambda body: f"<html><body><div>Site name</div><p>{body}</p><div>All rights</div></body></html>"
    rows = [
        (1, "http://h.org/a/1", page("one")),
        (2, "http://h.org/a/2?x=1", page("two")),
        (3, "http://h.org/b/9", page("nine")),
        (4, "http://other.org/a/1", page("alone")),
        (5, None, None),
        (6, "http://h.org/a/1", "<article><p>kept</p><p>kept</p></article>"),
        (3, "http://h.org/b/9", page("nine")),
        (None, "http://q.org", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    expected = {(1, "one"), (2, "two"), (4, "Site name\nalone\nAll rights"), (5, ""), (6, "kept\nkept"), (None, "")}
    clashing = pages.selectExpr("*", "1 as key", "2 as host", "3 as path", "4 as lines", "5 as deleted", "6 as number")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for frame, limit in ((pages, threshold), (clashing, threshold), (pages, "-1")):  # broadcast and shuffled
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        found = html_text.extract_text(frame).collect()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        assert len(found) == len(rows)
        assert {(r.page_id, r.text) for r in found} == expected | {(3, "nine")}
        assert all(r.n_chars == len(r.text) for r in found)
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_copies_and_mirrors_delete_no_text(spark):
    page = lambda *body: "<html><body><div>Site name</div>" + "".join(f"<p>{b}</p>" for b in body) + "<div>All rights</div></body></html>"
    rows = [
        (1, "http://h.org/a/1", page("one")),
        (2, "http://h.org/a/2", page("two")),
        (3, "http://h.org/b/9", page("nine")),
        (3, "http://h.org/b/9", page("nine")),  # repeated row
        (4, "http://h.org/b/9/mirror", page("nine")),
        (5, "http://c.org/x/1", page("own", "copied passage")),
        (6, "http://c.org/x/2", page("other", "copied passage")),
        (7, "http://c.org/y", page("third")),
        (8, "http://c.org/z", page("fourth")),
        (9, "http://two.org/a", page("same")),
        (10, "http://two.org/b", page("same")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = html_text.extract_text(pages).collect()
    assert len(found) == len(rows)
    whole = "Site name\nsame\nAll rights"
    assert {(r.page_id, r.text) for r in found} == {
        (1, "one"), (2, "two"), (3, "nine"), (4, "nine"), (5, "own\ncopied passage"), (6, "other\ncopied passage"),
        (7, "third"), (8, "fourth"), (9, whole), (10, whole),
    }


def brute_texts(rows):
    """Each page against the others of its host, by direct comparison."""
    lines = {i: html_text.page_lines(html)[0] for i, _, html in rows}
    split = {i: (url.split("/")[2], "/" + "/".join(url.split("/")[3:])) for i, url, _ in rows}
    out = {}
    for host in {h for h, _ in split.values()}:
        different = {}
        for i, (h, path) in split.items():
            if h == host:
                different.setdefault(tuple(lines[i]), []).append(path)
        order = sorted((min(paths), content) for content, paths in different.items())
        for at, (path, content) in enumerate(order):
            near = [order[k] for k in range(max(0, at - 2), min(len(order), at + 3)) if k != at]
            prefix = lambda other: next((k for k, (a, b) in enumerate(zip(path, other, strict=False)) if a != b), min(len(path), len(other)))  # noqa: E731, B023
            near.sort(key=lambda n: (-prefix(n[0]), n[0]))  # noqa: B023
            gone = set(html_text.shared_lines(list(content), [list(n[1]) for n in near]))
            for i in lines:
                if split[i][0] == host and tuple(lines[i]) == content:
                    out[i] = "\n".join(x for k, x in enumerate(content) if k not in gone)
    return out


def test_pages_without_landmarks_match_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for i in range(120):
        host = rng.choice(["a.org", "a.org", "b.org", "c.org"])
        body = [rng.choice(["Home", "About us", "Contact"]) for _ in range(2)]
        body += [f"paragraph {rng.randrange(60)}" for _ in range(rng.randrange(6))] + ["All rights reserved"]
        path = "/".join(rng.choice("xyz") for _ in range(rng.randint(1, 3)))
        rows.append((i, f"http://{host}/{path}/{i:03}", "".join(f"<p>{b}</p>" for b in body)))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    assert found == brute_texts(rows)
    assert sum("All rights reserved" not in t for t in found.values()) > 90


def made_up(rng, good):
    words = ["".join(rng.choice(["an", "ther", "in", "tion", "re", "st"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(30, 120))]
    return " ".join(words).capitalize() + "." if good else " ".join(w + rng.choice(["***", "$$$"]) for w in words)


def test_held_out_accuracy(spark, docs):
    rng = random.Random(2)
    rows = [(i, made_up(rng, i % 3 > 0), int(i % 3 > 0)) for i in range(400)]
    texts = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows] + [(7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    label = {r[0]: r[2] for r in rows}
    found = classifier.score_quality(texts, labels).collect()
    held = [r for r in found if r.held_out]
    assert len(found) == 400 and 40 < len(held) < 120
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.97
    awkward = classifier.score_quality(docs, labels).collect()
    assert len(awkward) == docs.count() and all(0 <= r.score <= 1 for r in awkward)
    kept = classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns


def test_without_labels(docs, no_docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in classifier.score_quality(docs, labels).collect()} == {0.5}
    assert classifier.score_quality(no_docs, labels).count() == 0


def test_votes_match_brute_force(spark):
    rng = random.Random(5)
    texts = [made_up(rng, i % 2 > 0) for i in range(90)] + ["same text twice"] * 40 + ["", "word " * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, rng.randrange(2)) for i in range(len(texts))], "doc_id long, quality int")
    model = classifier.learn(docs, labels)
    slots = classifier._WordSlots()
    expected = {}
    for i, text in enumerate(texts):
        where, values = classifier.features(text, slots)
        vector = sum(model.axes[s].astype(float) * v for s, v in zip(where, values, strict=True))
        vector = vector / np.linalg.norm(vector)
        cosines = [round(float(vector @ v) * classifier.DIGITS) for v in model.vectors.astype(float)]
        near = sorted(range(len(cosines)), key=lambda k: (-cosines[k], k))[: classifier.NEIGHBOURS]
        weights = [max(cosines[k] / classifier.DIGITS, 1e-6) ** classifier.SHARPNESS for k in near]
        expected[i] = sum(w * model.labels[k] for w, k in zip(weights, near, strict=True)) / sum(weights)
    found = {r.doc_id: r.score for r in classifier.score_quality(docs, labels).collect()}
    apart = [i for i in expected if abs(found[i] - expected[i]) > 1e-3]
    assert len(apart) <= 2, apart  # a cosine on the edge between two digits may change places
    assert len({round(found[i], 9) for i in range(90, 130)}) == 1


def test_blocks_do_not_change_scores():
    rng = random.Random(6)
    slots = classifier._WordSlots()
    rows = [classifier.features(made_up(rng, i % 2 > 0), slots) for i in range(300)]
    model = classifier.fit(rows, np.array([i % 2 for i in range(300)], float))
    one = np.concatenate([model.scores([r]) for r in rows])
    assert np.abs(model.scores(rows) - one).max() < 0.02 and np.mean(model.scores(rows) == one) > 0.9


def test_wording_alone_is_learnt():
    rng = random.Random(7)
    good, bad = (["".join(rng.choices("abcdefgh", k=6)) for _ in range(60)] for _ in range(2))
    slots = classifier._WordSlots()
    made = [classifier.features(" ".join(rng.choices(good if i % 2 else bad, k=40)), slots) for i in range(400)]
    model = classifier.fit(made[:300], np.array([i % 2 for i in range(300)], float))
    assert np.mean((model.scores(made[300:]) >= 0.5) == (np.arange(300, 400) % 2 == 1)) > 0.95


def test_labels_without_a_document_take_no_place(spark, monkeypatch):
    monkeypatch.setattr(classifier, "EXAMPLES", 30)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(4000)], "doc_id long, quality int")
    assert len(classifier.learn(docs, labels).labels) == 30

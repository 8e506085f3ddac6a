"""Spelling variants, centroid clustering and main texts of pages."""

import hashlib
import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tablelab.llm import shallot, spelling, template


def edits(word: str, letters: str) -> set:
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    return (out | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}) - {word}


def points(words):
    return [np.array([ord(c) for c in w], np.int64) for w in words]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=7), min_size=1, max_size=40))
def test_both_schemes_find_every_word_one_edit_apart(words):
    words = sorted(words)
    index, other = spelling.Index([p[::-1] for p in points(words)]), spelling.Index(points(words))
    halves = np.array([len(w) // 2 for w in words])
    found = set(zip(*(x.tolist() for x in spelling.one_error(index, points(words), halves))))
    back = [p[::-1] for p in points(words)]
    found |= set(zip(*(x.tolist() for x in spelling.one_error(other, back, np.array([len(w) for w in words]) - halves))))
    assert found == {(i, j) for i, w in enumerate(words) for j, v in enumerate(words) if v in edits(w, "abé")}


def test_index_steps_are_intervals_of_suffix_ranks():
    words = ["banana", "bandana", "ananas", "nab"]
    index = spelling.Index([p[::-1] for p in points(words)])
    for pattern in ["an", "ban", "anan", "nab", "x", "banana"]:
        low, high = np.array([0]), np.array([index.n])
        for symbol in index.codes(np.array([ord(c) for c in pattern])):
            low, high = index.step(np.array([symbol]), low, high)
        times = sum(w[i:].startswith(pattern) for w in words for i in range(len(w)))
        assert int(high[0] - low[0]) == times


def odd_texts():
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(5, 9))) for _ in range(60)]
    words += [random.Random(i).choice(sorted(edits(w, "abcé"))) for i, w in enumerate(words[:40])]
    words += ["x" * 5000, "x" * 4999, "x" * 4999 + "y", "ÀÉÎÕÜß×÷ÿ", "Wordword", "WORDWORD", "wördword"]
    rows = [(i, " ".join(rng.choices(words, weights=[30 if j % 7 == 0 else 2 for j in range(len(words))], k=80))) for i in range(120)]
    rows += [(i, " ".join(words[-7:])) for i in range(200, 240)] + [(None, " ".join(words)), (1, None), (2, ""), (3, "1234 ---"), rows[0], rows[0]]
    return [(i, t, "w", 1) for i, t in rows]


@pytest.mark.parametrize("block", [1 << 15, 16])
def test_variants_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    rows = odd_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int").repartition(3)
    got = spelling.variants(docs).collect()
    want = brute.spelling([r[:2] for r in rows])
    assert sorted(tuple(r) for r in got) == want
    assert sum(w[1] is not None for w in want) > 10 and any(len(w[0]) > 4000 for w in want)


def test_variants_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(empty).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect() == []


def test_roots_follow_chains(spark):
    chain = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", None), ("z", None)]
    found = spelling.with_roots(spark.createDataFrame(chain, "word string, form string"))
    assert {r.word: r.root for r in found.collect()} == {**{w: "f" for w, _ in chain[:6]}, "z": "z"}


def odd_vectors():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(9, 64))
    rows = [(i, (centres[i % 9] + rng.normal(size=64) * 0.3).tolist(), 0) for i in range(400)]
    rows += [(i, rows[3][1], 0) for i in range(400, 600)]  # a third and more are copies
    rows += [(600, None, 0), (601, [1.0] * 63, 0), (602, [None] * 64, 0), (603, [float("nan")] * 64, 0), (604, [float("inf")] * 64, 0), (605, [0.0] * 64, 0), (606, [-1e30] * 64, 0)]
    return [*rows, rows[5], rows[5], (None, rows[7][1], 0), (5, rows[9][1], 0)]


def test_clusters_match_brute_force(spark):
    rows = odd_vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int").repartition(5)
    found, centroids = shallot.cluster(table)
    want, at = brute.clusters([r[:2] for r in rows])
    assert sorted((tuple(r) for r in found.collect()), key=str) == want and centroids.tolist() == at
    digest = {i: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for i, c in enumerate(at)}
    for r in shallot.with_inertia(found, centroids).collect():
        assert r.inertia == sum(d for _, _, d in want) and r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == digest[r.cluster]


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_fewer_vectors_than_clusters(spark, n):
    rows = [(i, [float(i * j % 5) for j in range(64)]) for i in range(n)]
    found, centroids = shallot.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted(tuple(r) for r in found.collect()) == brute.clusters(rows)[0] and len(centroids) == n
    assert shallot.with_inertia(found, centroids).count() == n


def test_search_is_exact_from_any_start_and_measures_less():
    rng = np.random.default_rng(8)
    at = rng.integers(-3, 4, (12, 4))
    at[5] = at[2]  # ties
    x = rng.integers(-4, 5, (3000, 4))
    all_ = ((x[:, None] - at) ** 2).sum(axis=2)
    order = np.argsort(all_, axis=1, kind="stable")
    for start in [np.zeros(len(x), int), rng.integers(0, 12, len(x)), order[:, 0]]:
        second = rng.integers(0, 12, len(x))
        n, s, d1, d2 = shallot.search(x, start, second, shallot.Neighbours(at))
        assert (n == order[:, 0]).all() and (s == order[:, 1]).all()
        assert (d1 == np.sort(all_, axis=1)[:, 0]).all() and (d2 == np.sort(all_, axis=1)[:, 1]).all()


def site(i: int, body: str, article: bool = True) -> str:
    tag = "article" if article else "section"
    return (
        f"<html><head><title>T{i}</title><style>p{{}}</style><script>var a='<p>no</p>{i}';</script></head><body><nav><ul><li><a href='/'>Home {i}</a></li></ul></nav>"
        f"<div><p>We use biscuits &amp; more.</p><p>Accept</p></div><{tag}>{body}</{tag}><footer>&copy; {i}</footer></body></html>"
    )


ODD = [
    ("<article><h1>A &amp; B</h1><p>one\n two <b>th</b>ree<p>four<br>five</article>", "A & B one two three four five"),
    ("<article><p>x<nav>menu</nav><aside>side</aside>y</p><form>f</form><div class='Comments'>c</div><section id=ad-top>a</section>z</article>tail", "x y z"),
    ("<main><p>kept<script>if (a < b) '</p>'</script> on</p><!-- <p>gone</p> --></main><p>out</p>", "kept on"),
    ("<p>no article<div class='cookie-notice'>c</div><span class=advert>buy</span> here &lt;3 &#233;&nbsp;&unknown;", "no article here <3 é &unknown;"),
    ("<article>cut off in a <b", "cut off in a"),
    ("<article></article><p>outside</p>", ""),
    ("<nav>only", ""),
    ("plain text", "plain text"),
    ("", ""),
    ("<article><p title=\"a > b\">q</p><p title='x>r</p></article>", "q r"),
    ("<ARTICLE><P>upper</P></ARTICLE><SCRIPT>x</SCRIPT>", "upper"),
    ("<article><textarea>t</textarea><style>s</style>k</article>", "k"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a b c d"),
    ("<div></div></div></p>after", "after"),
]


@pytest.mark.parametrize("page, want", ODD)
def test_main_text_of_a_page(page, want):
    assert template.extract(page) == want


def test_pages_and_templates(spark):
    rng = random.Random(3)

    def prose():
        return " ".join(f"w{rng.randrange(1000)}" for _ in range(20))

    rows, want = [], {}
    for i in range(90):  # a host with a third and more of the pages, articles without an article element, copies of one text
        body = prose() if i % 3 else "the same text on many pages"
        rows.append((i, f"http://User@A.example:80/{i}", site(i, f"<p>{body}</p><p>shared &eacute; end</p>", article=i % 2 == 0)))
        want[i] = f"{body} shared é end" if i % 2 == 0 else body
    for i in range(90, 92):  # too few pages for a template
        rows.append((i, "https://b.example/x", site(i, "<p>short</p>", article=False)))
        want[i] = "We use biscuits & more. Accept short"
    rows += [(100, None, None), (101, "x", ""), (102, "http://c.example", "<p>" + "long " * 200_000), rows[4], rows[4]]
    want |= {100: "", 101: "", 102: " ".join(["long"] * 200_000)}
    table = spark.createDataFrame([(*r, "t", 9) for r in rows], "page_id long, url string, html string, text string, host int").repartition(4)
    for limit in (template.BROADCAST, 0):
        template_limit, template.BROADCAST, template.SALT = template.BROADCAST, limit, 8
        try:
            got = template.main_texts(table).collect()
        finally:
            template.BROADCAST, template.SALT = template_limit, 4096
        assert len(got) == len(rows)
        for r in got:
            assert (r.text, r.n_chars) == (want[r.page_id], len(want[r.page_id]))
            assert r.url == next(u for i, u, _ in rows if i == r.page_id)
    assert template.main_texts(table.limit(0)).collect() == []


def test_templates_match_brute_force(spark):
    rows = []
    rng = random.Random(9)
    for i in range(24):
        host = i % 2
        body = "".join(f"<p>w{rng.randrange(10**6)}</p>" for _ in range(rng.randint(1, 4)))
        notice = "<div><h2>Note</h2><p>Mind the gap</p></div>" if i % 5 else ""
        lists = "".join("<dl><dt>K</dt><dd>V</dd></dl>" for _ in range(rng.randint(1, 3)))
        turned = "<i>x</i><h3>b</h3><h4>c</h4>" if i % 3 else "<h4>c</h4><h3>b</h3>"
        rows.append((i, f"http://h{host}.example/", f"<body>{notice}<section>{body}</section>{lists}{turned}</body>"))
    found, _ = template.deduce_templates(spark.createDataFrame(rows, "page_id long, url string, html string"))
    tokens = {}
    for _, url, html in rows:
        tokens.setdefault(url, []).append([n for n, *_ in template.tokens(html) if n])
    want = brute.templates([(u, t) for u, ts in tokens.items() for t in ts], template.TOKENS, template.PAGES)
    classes = {}
    for r in found.collect():
        for c in r.template:
            classes.setdefault((r.host, c["class"]), set()).add(c["token"] % (1 << 64))
    assert {frozenset(c) for c in classes.values()} == set().union(*want.values()) and len(want) == 2 and all(want.values())


def test_interleaved_classes_lose_the_smaller_one(spark):
    number = {t: i + 1 for i, t in enumerate("abcxyq")}
    of = [(number["a"], 1), (number["b"], 1), (number["c"], 1), (number["x"], 2), (number["y"], 2)]
    rows = [(7, [number[t] for t in page], [{"token": t, "class": c} for t, c in of]) for page in ("axbycq", "qaxbyc")]
    table = spark.createDataFrame(rows, "host long, tokens array<long>, template array<struct<token:long,class:long>>")
    found = {(r["class"], r["whole"]) for r in template._checked(table).collect()}
    assert found == {(1, True), (2, False)}

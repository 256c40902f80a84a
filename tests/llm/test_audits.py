"""Whitening against numpy, the filter audit against counting, main text against hand-made pages."""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from compare import DATA, differences
from kinolith.llm import filter_audit, html_dom, html_extraction, html_pages, queries, whitening

# whitening


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, id long, v string, component int")


def drawn(n, dim, seed=3):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, dim)) * np.linspace(0.2, 1, dim)).astype(np.float32)


def whitened(x, components=4):
    """Brute force: per row the integers, the covariance of the distinct ones, its eigenvectors."""
    whole = np.floor(256 * x.astype(float)).astype(np.int64)
    fit = np.unique(whole, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    off = fit - sums / n
    values, turns = np.linalg.eigh(off.T @ off / n)
    values, turns = values[::-1], turns[:, ::-1]
    white = (whole - sums / n) @ turns[:, :components] / np.sqrt(values[:components])
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in whole]
    return n, deviation, white, values / values.sum()


@pytest.mark.parametrize(("n", "dim"), [(300, 6), (400, 40), (5, 3)])
def test_whitening(spark, n, dim):
    x = drawn(n, dim)
    x[n // 2] = x[0]
    odd = [(-1, None), (-2, [1.0] * (dim - 1) + [None]), (-3, [float("nan")] * dim), (-4, [float("inf")] * dim), (-5, [])]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + odd + [(None, [float(c) for c in x[0]])]
    found = whitening.whiten(vectors(spark, [(i, v, 1, "x", 2) for i, v in rows])).collect()
    count, deviation, white, explained = whitened(x)
    many = min(4, dim)
    assert len(found) == (n + 1) * many
    assert {r["n"] for r in found} == {count} and max(r["identity_error"] for r in found) < 1e-9
    turn = {}
    for r in found:
        i = 0 if r["vec_id"] is None else r["vec_id"]
        j = r["component"] - 1
        sign = turn.setdefault(j, np.sign(r["whitened"] * white[i, j]))
        assert int(r["deviation"]) == deviation[i]
        assert abs(sign * r["whitened"] - white[i, j]) < 1e-7
        assert abs(r["explained"] / explained[j] - 1) < 1e-9


def test_whitening_converges_without_the_full_dimension(spark):
    x = drawn(500, 60)
    x[:, :4] *= np.array([90, 60, 40, 30])
    rows = vectors(spark, [(i, [float(c) for c in v], 1, "x", 2) for i, v in enumerate(x)])
    whole = whitening.integer_vectors(rows)
    fitted = whitening.fit(whole.select("v").distinct(), 60)
    assert fitted.width == 12
    count, _, _, explained = whitened(x)
    assert fitted.n == count and np.allclose(fitted.values / fitted.trace, explained[:4], rtol=1e-9)


def test_whitening_without_rank(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 0, "", 0)] * 3)).count() == 0  # all equal: no component
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 0.0], 0, "", 0) for i in range(5)])).collect()
    assert {r["component"] for r in line} == {1} and len(line) == 5 and abs(line[0]["explained"] - 1) < 1e-9
    two = whitening.whiten(vectors(spark, [(i, [float(i * i % 7)] * (1 + i % 2), 0, "", 0) for i in range(20)])).collect()
    assert Counter(r["vec_id"] for r in two) == Counter(range(20))  # each length has its own fit


def test_whitening_of_large_entries(spark):
    rows = [(i, [float(2.0**40 * i), float(-i)], 0, "", 0) for i in range(4)]
    found = whitening.whiten(vectors(spark, rows)).collect()
    sums = [sum(256 * 2**40 * i for i in range(4)), sum(-256 * i for i in range(4))]
    want = {i: (4 * 256 * 2**40 * i - sums[0]) ** 2 + (-4 * 256 * i - sums[1]) ** 2 for i in range(4)}
    assert {r["vec_id"]: int(r["deviation"]) for r in found} == want


# filter audit

DOC = "doc_id long, text string, lang string, mask int, part string, n long"


def audited(docs, labels):
    """Brute force: each order is applied document by document."""
    known = defaultdict(lambda: [False, False])
    for i, quality, toxic in labels:
        known[i][0] |= quality == 1
        known[i][1] |= toxic == 1
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = [
            len(words) < 100,
            100 * len(set(words)) < 80 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            re.search(r"[#$%&*|]", text) is not None,
            i is not None and first[text] < i,
        ]
        good, toxic = known[i] if i is not None else (False, False)
        rows.append((lang or "", {f for f, x in zip("ABCDE", failed) if x}, good, toxic))
    out = set()
    taken = Counter()
    counts = {}
    for order in map("".join, itertools.permutations("ABCDE")):
        left = {k: True for k in range(len(rows))}
        for step, f in enumerate(order, 1):
            c = defaultdict(Counter)
            for k, (part, failed, good, toxic) in enumerate(rows):
                here = left[k] and f in failed
                c[part].update(removed=here, redundant=not left[k] and f in failed, unique=failed == {f}, good=here and good, toxic=here and toxic)
                left[k] &= f not in failed
                c[part]["kept"] += left[k]
                taken[part, f] += here
            for part, x in c.items():
                counts[part, order, step] = x
    for (part, order, step), x in counts.items():
        out.add((part, order, step, x["kept"], x["removed"], x["redundant"], x["unique"], x["good"], x["toxic"], taken[part, order[step - 1]]))
    return out


def test_filter_audit(spark):
    long = " ".join(f"w{i}" for i in range(120))
    texts = [None, "", long, long, long + " #", "A" * 50 + " " + long, "x " * 150, "É \x0b\x0c" + long, long.upper(), " \t\n", "ab cd " * 100, "one & two"]
    docs = [(i, t, ("en", "de", None, "")[i % 4]) for i, t in enumerate(texts)]
    docs += [(20, long, "en"), (20, long, "en"), (20, long, "de"), (2, long, "en"), (None, long, "en"), (None, None, None), (7, "other", "fr"), (3, "x " * 150, "fr")]
    labels = [(2, 1, 0), (2, 0, 1), (6, 1, None), (20, None, 1), (8, 0, 0), (None, 1, 1), (999, 1, 1), (3, 1, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame([(*d, 1, "p", 3) for d in docs], DOC)
    found = filter_audit.audit(frame, known).collect()
    assert len(found) == 600 * 4
    assert {tuple(r) for r in found} == audited(docs, labels)
    assert filter_audit.audit(spark.createDataFrame([], DOC), known).count() == 0


def test_cells_invert_exactly(spark):
    rows = [("p", m, m % 3 == 0, m % 5 == 0, m * 10**12 + 1) for m in range(32)]
    frame = spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean, n long")
    (found,) = filter_audit.cells(filter_audit.parity_sums(frame)).collect()
    assert found["all"] == [r[4] for r in rows]
    assert found["good"] == [r[4] * r[2] for r in rows] and found["toxic"] == [r[4] * r[3] for r in rows]


# main text


@pytest.fixture(scope="module")
def model():
    return html_extraction.default_model()


S = "Dorevi lan opo, seta mi koru. "
HELD_OUT = [
    # (page, its main text); layouts and names that no template has
    ("<html><body><div id=masthead-x><a href=/>Home</a> <a href=/a>Shop</a></div><div class=leftnav><a href=1>Abc</a><br><a href=2>Def</a></div>"
     f"<div class='story__body'><h1>Titel hier</h1><p>{S * 3}<p>{S * 2}<i>und</i> mehr.<p>Kurz.</div><div class=page-footer>© 2020 Firma</div>",
     f"Titel hier\n\n{(S * 3).strip()}\n\n{S * 2}und mehr.\n\nKurz."),
    (f"<body><header><nav><a href=/>x</a></nav></header><main><article><header><h1>A &lt; B &amp; C</h1></header><p>{S}</p><ul><li>eins<li>zwei drei</ul>"
     f"<aside class=ad-unit>Kauf jetzt billig! {S}</aside><p>Ende&nbsp;gut.</p></article><section id=comments><h3>2 Comments</h3><article class=comment><p>{S * 2}</p></article></section></main>",
     f"A < B & C\n\n{S.strip()}\n\neins\n\nzwei drei\n\nEnde gut."),
    (f"<table width=100%><tr><td class=menu><a href=a>One</a><br><a href=b>Two</a></td><td><h2>Alt</h2>{S}<br><br>{S}</td></tr></table><div id=footer>Copyright 1999 by us. All rights reserved.</div>",
     f"Alt\n\n{S.strip()} {S.strip()}"),
    (f"<body><div class='cookie-banner'><p>We use cookies. {S}</p><button>OK</button></div><article><h1>T</h1><p>{S}</p><script>document.write('<p>no</p>')</script><p>{S}</p></article>"
     f"<div class='newsletter'><form><p>{S}</p><input></form></div><footer><p>{S}</p></footer>",
     f"T\n\n{S.strip()}\n\n{S.strip()}"),
    (f"<div class=wrap><nav><ul><li><a href=1>a</a><li><a href=2>b</a></ul></nav><div class=post><h1>Kop</h1><blockquote><p>{S}</p></blockquote><table><tr><td>1<td>2</table><p>{S}</div>"
     f"<div class=sidebar><h3>About</h3><p>{S * 2}</p></div><div class='related'><h4>More</h4><ul><li><a href=x>{S}</a></ul></div></div>",
     f"Kop\n\n{S.strip()}\n\n1\n\n2\n\n{S.strip()}"),
]


@pytest.mark.parametrize("at", range(len(HELD_OUT)))
def test_pages_of_other_layouts(model, at):
    page, want = HELD_OUT[at]
    assert model.extract([page]) == [want]


def test_held_out_drawn_pages(model):
    right = Counter()
    for page in html_pages.pages(150, seed=99):
        tree, state = html_extraction.labelled(page)
        (chance,) = model.marginals([tree])
        for i in tree.texts:
            right[bool(state[i]), bool(chance[i] >= 0.5)] += 1
    assert right[True, True] / (right[True, True] + right[True, False]) > 0.98
    assert right[True, True] / (right[True, True] + right[False, True]) > 0.98


def test_marginals_by_enumeration(model):
    """Messages give what the sum over all states gives."""
    trees = [html_dom.read(p) for p in ("<div class=ad><p>a b<p>c</div><article>d <b>e</b></article>", "x<ul><li>y<li><a>z</a></ul>", "<p>only")]
    for tree, chance in zip(trees, model.marginals(trees)):
        forest = html_extraction.Forest([tree], model.nodes, model.edges)
        own, edge = forest.potentials(model.weights, model.ties)
        many = len(own)
        total, each = 0.0, np.zeros(many)
        for states in itertools.product((0, 1), repeat=many):
            log = sum(own[i] * states[i] for i in range(many))
            log += sum(edge[i][states[p]][states[i]] for i, p in enumerate(tree.parent) if p >= 0)
            total += np.exp(log)
            each += np.exp(log) * np.array(states)
        assert np.allclose(each / total, chance)


def test_reading_malformed_pages():
    texts = lambda page: [t for _, t in sorted(html_dom.read(page).texts.items())]
    assert texts("a<p>b<b>c<br>d<p>e</b>f") == ["a", "bc d", "ef"]
    assert texts('<p title="a>b">x</p><!-- <p>no --><p data-x=\'>\'>y<style>p{}</style>z') == ["x", "yz"]
    assert texts("<script>var a='</p>';</script>t<script>never closed") == ["t"]
    assert texts("1 < 2 & 3 &lt; 4 &#x41; &eacute;&nbsp;!") == ["1 < 2 & 3 < 4 A é !"]
    assert texts("<select><option>no</select>yes<noscript>no</noscript>") == ["yes"]
    assert texts("<head><title>no</title>yes") == ["yes"]
    assert texts("x</") == ["x"] and texts("x<p") == ["x"] and texts("") == [] and texts("<p don't>x</p>") == ["x"]
    assert texts("<tr><td>a<td>b<tr><td>c") == ["a", "b", "c"]


def test_extraction_of_odd_rows(spark, model):
    long = "<article>" + f"<p>{S}</p>" * 20_000 + "</article>"
    rows = [(1, None, 5), (2, "", 5), (3, "<nav><a href=x>a</a></nav>", 5), (4, long, 5), (4, long, 5), (5, "<div>" * 3000 + f"<p>{S * 4}</p>", 5)]
    pages = spark.createDataFrame(rows, "page_id long, html string, N_chars int")
    found = {r["page_id"]: r["text"] for r in html_extraction.extract(pages.drop("N_chars")).collect()}
    assert found[1] == found[2] == found[3] == "" and found[4].count("\n\n") == 19_999 and found[5] == (S * 4).strip()
    assert html_extraction.extract(pages.where("page_id > 9")).count() == 0


def test_extraction_of_pages(spark):
    """The table's articles are the text between <article> tags; blocks are its headings and paragraphs."""
    from html import unescape

    found = {r["page_id"]: r for r in queries.op13_html_extraction(spark, DATA).collect()}
    for row in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", row["html"], re.S).group(1)
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n\n".join(b for b in blocks if b)
        assert (found[row["page_id"]]["text"], found[row["page_id"]]["n_chars"]) == (want, len(want))


def test_audit_sql(spark):
    name = "op12_filter_audit"
    assert not differences(name, queries.queries()[name](spark, DATA), queries.oracle_sql()[name])

"""Template deduction against brute force, and pages whose layout only the template tells."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from parlance.llm import html

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa".split()


def soup(r, i, copy=None):
    """A page of nothing but div, with random menu, advert and story."""
    some = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    story = copy or [some(r.randint(20, 60)) for _ in range(r.randint(1, 4))]
    menu = "".join(f"<div><a href='/{r.random()}'>{some(2)}</a></div>" for _ in range(r.randint(2, 6)))
    body = "".join(f"<div>{p}</div>" for p in story)
    return f"<div id=x1>{menu}</div><div id=x2><div>{some(5)}</div></div><div id=x3><div>Read on for more</div>{body}</div><div id=x4>{some(6)}</div>", " ".join(story)


def pages(seed):
    r = random.Random(seed)
    rows, want = [], {}
    same = [" ".join(["one story that stands on every page of its host"] * 5)]
    for i in range(60):
        host = r.choice(["a.org", "b.org", "c.org"])
        page, story = soup(r, i)
        rows.append((i, f"https://{host}/{i}", page))
        want[i] = story
    for i in range(100, 106):
        page, story = soup(r, i, same)
        rows.append((i, f"https://copies.org/{i}", page))
        want[i] = story
    rows += [rows[0], rows[0], (900, None, None), (901, "", "")]
    return rows, want


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_layout_without_names(spark):
    rows, want = pages(1)
    got = {r.page_id: r.text for r in html.extract(frame(spark, rows)).collect()}
    assert all(got[i] == w for i, w in want.items() if i < 100)
    assert all(w in got[i] and "Read on" in got[i] for i, w in want.items() if i >= 100)  # equal on all pages: no telling which is template
    assert got[900] == got[901] == ""
    parsed = html.parse(frame(spark, rows).withColumn("host", html.host_of(F.col("url"))))
    found, fixed = html.templates(parsed)
    assert {r.t_host for r in found.collect()} == {"a.org", "b.org", "c.org", "copies.org"}
    plain = {r.page_id: r.text for r in html.extract(frame(spark, rows), (found.limit(0), fixed.limit(0))).collect()}
    assert all(plain[i] != w for i, w in want.items())


def test_classes_against_brute_force(spark):
    rows, _ = pages(2)
    parsed = html.parse(frame(spark, rows).withColumn("host", html.host_of(F.col("url")))).cache()
    each = parsed.dropDuplicates(["host", "print"]).select("host", "print", "free", F.explode("seen").alias("t")).select("host", "print", "free", "t.*")
    got = defaultdict(set)
    for r in html.token_classes(each).collect():
        got[r.host, r.a, r.b, r.pages].add(r.token)
    vectors, seen = defaultdict(dict), set()
    for r in parsed.collect():
        if (r.host, r["print"]) not in seen:
            seen.add((r.host, r["print"]))
            for t in r.seen:
                vectors[r.host, t.token][r["print"]] = t.n
    want = defaultdict(set)
    for (host, token), v in vectors.items():
        want[host, frozenset(v.items())].add(token)
    assert Counter((k[0], frozenset(v)) for k, v in got.items()) == Counter((k[0], frozenset(v)) for k, v in want.items())


@pytest.mark.parametrize(
    "page,want",
    [
        ("<p title=it's>Hello world</p><p>second it's here</p><p>third</p>", "Hello world second it's here third"),
        ("<article class='related-work'><p>x</p><div class='social-science'>y</div><div class=comments>c</div></article>", "x y"),
        ("<p a=\"x>y\"b='>'>q</p><a href=/x/>r</a>s", "q rs"),
        ("5 < 6 and <3<!-- - --x --> b<!--> c</ x>", "5 < 6 and <3 b c"),
        ("<b>u<p>v</b> w</p>z", "u v w z"),
        ("<table><tr><td>a<td>b</div>c</table>d", "a bc d"),
        ("<p>" + "x" * 300_000, "x" * 300_000),
        ("<p " + "a=b " * 100_000, ""),
        ("<" * 100_000, "<" * 100_000),
    ],
)
def test_markup(page, want):
    assert " ".join(b[1] for b in html.Page(page).blocks if not b[3]) == want


def test_clash(spark):
    with pytest.raises(ValueError):
        html.extract(spark.createDataFrame([(1, "u", "h", 1)], "page_id long, url string, html string, slots int"))


def test_heading_outside_the_slot(spark):
    page = lambda i: f"<div id=top><h1>The Site</h1></div><div id=head><h1>Title number {i}</h1></div><div id=body><p>A story of {i} things that goes on for a good while, {i * 7} words or so.</p></div>"
    rows = [(i, f"http://h.org/{i}", page(i)) for i in range(12)]
    got = {r.page_id: r.text for r in html.extract(frame(spark, rows)).collect()}
    assert all(got[i] == f"Title number {i} A story of {i} things that goes on for a good while, {i * 7} words or so." for i in range(12))


def test_a_heading_outside_main_stays_whatever_the_hosts_size(spark):
    page = lambda i: f"<body><nav>menu</nav><div class=top><h1>Title {i}</h1></div><main><p>Text {'of the article ' * 5}{i}.</p></main><div>{i} more things</div></body>"
    rows = [(h * 100 + i, f"https://h{h}.example/{i}", page(i)) for h, n in ((1, 1), (2, 2), (4, 4)) for i in range(n)]
    out = html.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == {p: f"Title {p % 100} Text {'of the article ' * 5}{p % 100}." for p, _, _ in rows}

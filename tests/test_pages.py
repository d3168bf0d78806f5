import pytest
from pyspark.sql import functions as F

from rankatlas.functions import urls
from rankatlas.operators import extract as X
from rankatlas.operators import html as H

# The generic syntax's own examples, for the base http://a/b/c/d;p?q
RESOLVED = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s",
    "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/",
    "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g",
    "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/",
    "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http:g",
}


def test_references_resolve_as_the_syntax_says(spark):
    rows = spark.createDataFrame([(k,) for k in RESOLVED], "ref string").select("ref", urls.resolve(F.lit("http://a/b/c/d;p?q"), F.col("ref")).alias("to")).collect()
    assert {r.ref: r.to for r in rows} == RESOLVED


@pytest.mark.parametrize(
    ("base", "ref", "want"),
    [
        ("https://shop.de", "contact", "https://shop.de/contact"),
        ("HTTPS://Shop.DE:443/a", "../x/./y/..", "https://shop.de/x/"),
        ("http://shop.de:8080/a/b?q#f", " /c\n?d ", "http://shop.de:8080/c?d"),
        ("http://me@Shop.de:80", "//Other.de:", "http://other.de/"),
        ("https://shop.de/a", "mailto:Me@shop.de", "mailto:Me@shop.de"),
        ("shop.de/a", "b", None),
        (None, "b", None),
        ("https://shop.de", None, None),
    ],
)
def test_normal_form(spark, base, ref, want):
    row = spark.createDataFrame([(base, ref)], "base string, ref string").select(urls.normalized(urls.resolve(F.col("base"), F.col("ref"))).alias("to")).first()
    assert row.to == want


def test_origin(spark):
    rows = spark.createDataFrame([("HTTP://u:p@A.b:80/x",), ("https://a.b:444",), ("mailto:x@y",), ("a/b",), (None,)], "u string").select(urls.origin(F.col("u")).alias("o")).collect()
    assert [r.o for r in rows] == ["http://a.b", "https://a.b:444", None, None, None]


def elements(page):
    r = H.PageReader().read(page)
    return r, {(n, tag): ("".join(r.text)[a:b].split(), last) for n, last, tag, _, a, b in r.elements}


def test_reader_nests_and_decodes():
    r, found = elements("<div id=a>x&amp;y<p>one<p hidden>two<br>three</div><ul><li>1<li aria-hidden=true>2<ul><li>in</ul><li>3&nbsp;4</ul></b>end")
    assert found[0, "div"] == (["x&y", "one", "two", "three"], 3) and found[3, "br"] == ([], 3)
    assert [v for k, v in found.items() if k[1] == "li"] == [(["1"], 5), (["2", "in"], 8), (["in"], 8), (["3", "4"], 9)]
    assert "".join(r.shown).split() == ["x&y", "one", "1", "3", "4", "end"]
    assert list(elements("<tr><td>a<td>b<tr><td>c")[1].values()) == [(["a", "b"], 2), (["a"], 1), (["b"], 2), (["c"], 4), (["c"], 4)]


def test_reader_keeps_scripts_apart():
    r, _ = elements("<title>T</title><script>if (a<b) '</p>'</script><style>p{}</style><noscript>n</noscript><svg><path/><text>s</text></svg><b>bo</b><i>ld</i>")
    assert "".join(r.shown).split() == ["T", "bold"] and "".join(r.text).split() == ["T", "n", "s", "bold"] and r.scripts == [["", "if (a<b) '</p>'"]]


PAGE = """<html><head><base href="/shop/"><meta property="og:email" content="Meta&#64;shop.de"><meta name="x" content="no@shop.de">
<script type="application/ld+json">{"@type":["Thing","LocalBusiness"],"name":"Joe\\u0027s","email":"ld\\u0040shop.de","contactPoint":[{"email":"mailto:cp@shop.de"},{"member":{"author":"au@shop.de"}}],"other":{"email":"nested@no.de"},
 "address":[{"streetAddress":"1 Main St","addressLocality":"Boca","addressRegion":"FL","postalCode":33431}],"geo":{"latitude":"26.5","longitude":-80},"aggregateRating":{"ratingValue":"4.5","reviewCount":"12"}}</script>
<script type="application/ld+json">{broken</script>
<script type="application/ld+json">[{"@graph":[{"@type":"ItemList","itemListElement":[{"@type":"ListItem","item":{"@type":"Restaurant","name":"Deep","address":"2 Side Ave","telephone":5615263512,"aggregateRating":{"ratingValue":"good"}}}]}]}]</script></head>
<body><a href="mailto:First&#64;Shop.de?subject=x">m</a> sales&#64;shop.de&nbsp;<p hidden>hid&#64;shop.de</p><p>spl<b>it&#64;</b>shop.de</p>
<a href="../contact?a=1&amp;b=2">Write</a><a href="team.html"><b>Our</b> People</a><a href="https://shop.de:443/./about">About&nbsp;us</a><a href="/contact?a=1&amp;b=2">again</a>
<a href="https://else.example/about">y</a><a href="#contact">c</a><a href="preaching">no</a><a href="x1">Reach</a><a href="x2">support</a><a href="javascript:about()">j</a></body></html>"""


def frame(spark, *pages):
    return spark.createDataFrame([(f"https://shop.de/a/b{i}", p) for i, p in enumerate(pages)], "url string, html string")


def test_harvest_reads_what_a_browser_shows(spark):
    rows = X.harvest_emails(frame(spark, PAGE, None, "")).collect()
    # nested@no.de is raw text of the page only; hidden and encoded text is found by none
    assert [r.emails for r in rows] == [["first@shop.de", "sales@shop.de", "split@shop.de", "ld@shop.de", "cp@shop.de", "au@shop.de", "meta@shop.de", "no@shop.de", "nested@no.de"], [], []]
    assert rows[0].__fields__ == ["url", "html", "emails"]


def test_contact_links_are_resolved(spark):
    rows = X.contact_links(frame(spark, PAGE, PAGE, None)).orderBy("url", "nth").collect()
    want = ["https://shop.de/contact?a=1&b=2", "https://shop.de/shop/team.html", "https://shop.de/about", "https://shop.de/shop/#contact", "https://shop.de/shop/x1"]
    assert [(r.nth, r.target) for r in rows] == [*enumerate(want, 1)] * 2
    assert X.links(frame(spark, PAGE)).count() == 11


def test_jsonld_values_as_they_come(spark):
    rows = X.extract_jsonld(frame(spark, PAGE)).collect()
    assert [(r.name, r.address, r.city, r.state, r.zip, r.lat, r.lng, r.rating, r.review_count, r.phone) for r in rows] == [
        ("Joe's", "1 Main St", "Boca", "FL", "33431", 26.5, -80.0, 4.5, 12, None),
        ("Deep", "2 Side Ave", None, None, None, None, None, None, None, "+15615263512"),
    ]


LOCAL = """<div data-entityid="e1"><h2>Joe&#39;s &amp; Co</h2><span aria-label="Rated 4.5 out of 5, 1.9K user reviews"></span><div class="address x">1 Main St</div><a class="website" href="https://joes.example/?a=1&amp;b=2">s</a> (561)&nbsp;526-3512</div>
<div><h2>Second</h2><p>at 22 Long Oak Ave, open</p><b data-cid="c2"></b></div><div><h2>Joe&#39;s &amp; Co</h2></div><h2> </h2>"""


def test_local_results(spark):
    got = [tuple(r)[1:] for r in X.extract_local(frame(spark, LOCAL, None)).orderBy("rank").collect()]
    assert got == [(1, "Joe's & Co", "1 Main St", "+15615263512", 4.5, 1900, None, "https://joes.example/?a=1&b=2", "e1"), (2, "Second", "22 Long Oak Ave", None, None, None, None, None, "c2")]


def test_equal_pages_stay_apart(spark):
    same = spark.createDataFrame([("u", LOCAL), ("u", LOCAL)], "url string, html string")
    for df in (same, same.select("html")):
        assert sorted(r["rank"] for r in X.extract_local(df).collect()) == [1, 1, 2, 2]
        assert sorted((r["rank"], r.name) for r in X.extract_listings(df, r"<h2>(.*?)</h2>", {}).collect())[:2] == [(1, "Joe&#39;s &amp; Co")] * 2
        block = df.withColumn("html", F.lit('<div class="result"><h2><a href="https://a.b/">T</a></h2></div>'))
        assert [r.position for r in X.extract_organic(block).collect()] == [1, 1]


def test_organic_results(spark):
    page = """<div class="result x"><a class="icon" href="/i"></a><h2><a class="result__a" href="//d.example/l/?uddg=https%3A%2F%2FA.b%2Fc%3Fx&amp;rut=1">A &lt;b&gt; <b>c</b></a></h2><a class="result__snippet">call&nbsp;<b>561</b>-526-3512 &hellip;</a></div>
    <div class="result"><a href="/inner">none</a></div><div class="result"><a href="https://x.y/"></a></div><div class="result"><div><a href="https://x.y/">T</a></div></div>"""
    rows = X.extract_organic(frame(spark, page, "<div>none</div>").withColumnRenamed("url", "page")).orderBy("position").collect()
    assert [(r.position, r.title, r.url, r.domain, r.snippet) for r in rows] == [(1, "A <b> c", "https://A.b/c?x", "a.b", "call 561-526-3512 …"), (2, "T", "https://x.y/", "x.y", "")]
    with pytest.raises(ValueError, match="tell pages apart"):
        X.listings_from_snippets(spark.createDataFrame([(1, "t", "u", "d", "s")], "position int, title string, url string, domain string, snippet string"))


def test_related(spark):
    page = '<div data-q="a &amp; b"></div><div class="related-question-pair"><span>What?</span></div><div data-lk="l"></div><div data-q="a &amp; b"></div><div class="s75CSd"><a>more</a></div><div id="brs"><p><a>pizza <b>near</b></a></p></div>'
    assert [r.text for r in X.extract_related(frame(spark, page)).orderBy("position").collect()] == ["a & b", "What?", "l"]
    assert [r.text for r in X.extract_related(frame(spark, page), X.RELATED).orderBy("position").collect()] == ["more", "pizza near"]


def test_pages_are_read_once(spark):
    read = H.read_elements(frame(spark, PAGE))
    assert X.harvest_emails(read).columns[-2:] == ["_page", "emails"] and X.extract_jsonld(read).count() == 2
    assert "Exchange" not in X.extract_local(frame(spark, LOCAL))._jdf.queryExecution().executedPlan().toString()


def test_work_grows_with_the_page():
    """A page of a hundred thousand items takes no more for each than a short one does, and an item holds its own text only."""
    import time

    def walk(n):
        page = "".join(f"<div class='result'><h2><a href='https://x{i}.y/'>T{i}</a></h2><p class='st'>s{i}</p></div>" for i in range(n))
        r, began = H.PageReader().read(page), time.process_time()
        found = list(H._cut("".join(r.text), r.elements, X.ORGANIC["block"], ["a[href]"], ["a[href]"], (), False, False))
        return found, time.process_time() - began

    (few, short), (many, long) = walk(2_000), walk(100_000)
    assert len(few) == 2_000 and long < 200 * short + 1  # a power of 1 would be 50 times, of 2 2,500 times
    assert [x["text"].split() for x in many[99_998:]] == [["T99998", "s99998"], ["T99999", "s99999"]]


def test_items_of_pages_that_are_read(spark):
    html = '<div class="address" data-cid="c"><h2>A</h2><p class="address">1 Main St<h2>B</h2></p><h3>no</h3></div><h2>A</h2><b data-cid="d"></b><h2>C<h3>D</h3>call 561-526-3512</h2>'
    got = X.extract_local(frame(spark, html)).orderBy("rank").collect()
    assert [(r["rank"], r.name, r.address, r.phone, r.place_id) for r in got] == [(1, "A", "1 Main St B", None, "c"), (2, "B", None, None, "c"), (3, "no", None, None, "c"), (4, "C D call 561-526-3512", None, None, None), (5, "D", None, "+15615263512", None)]
    pages = frame(spark, html, LOCAL)
    assert X.extract_local(H.read_elements(pages)).drop("_page", "html").collect() == X.extract_local(pages).collect()
